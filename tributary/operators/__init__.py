"""The relational operators of convergence: align, feasibility, derive, verify, publish, origin."""
