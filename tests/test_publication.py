import pytest

from tributary.errors import Conflicted, Refusal
from tributary.sources.publication import free_name, probe_noreplace, publish_directory, publish_document, rename_noreplace


def test_names_that_are_taken(tmp_path):
    probe_noreplace(tmp_path)
    (tmp_path / "file").write_text("old")
    (tmp_path / "dir").mkdir()
    (tmp_path / "link").symlink_to("nowhere")
    for name in ("file", "dir", "link"):
        with pytest.raises(Conflicted):
            publish_document({"a": 1}, tmp_path / name, [])
    assert (tmp_path / "file").read_text() == "old"
    publish_document({"a": 1}, tmp_path / "new", [])
    assert (tmp_path / "new").read_bytes() == b'{"a":1}'
    assert sorted(p.name for p in tmp_path.iterdir()) == ["dir", "file", "link", "new"]


def test_protected_paths(tmp_path):
    (tmp_path / "in").mkdir()
    for bad in (tmp_path / "in", tmp_path / "in" / "x", tmp_path):
        with pytest.raises(Conflicted):
            free_name(bad, [tmp_path / "in"])
    with pytest.raises(Refusal):
        free_name(tmp_path / "no" / "x", [])


def test_directories(tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
    publish_directory(tmp_path / "a", tmp_path / "new", [])
    with pytest.raises(Conflicted):
        publish_directory(tmp_path / "b", tmp_path / "c", [])
    with pytest.raises(Conflicted):
        rename_noreplace(tmp_path / "b", tmp_path / "c")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b", "c", "new"]
