"""The verifier shares no planning or alignment code, and nothing outside llm imports llm."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent / "tributary"


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom):
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_verifier_is_independent():
    banned = ("tributary.plans.lattice", "tributary.operators.align", "tributary.operators.feasibility", "tributary.plans.decisions")
    for name in ("derive.py", "verify.py"):
        assert not [i for i in imports(ROOT / "operators" / name) if i.startswith(banned)]


def test_nothing_outside_imports_llm():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [i for i in imports(path) if i.startswith("tributary.llm")], path
