"""The planning layer: types, the lattice, plans, decisions. Driver-side, without Spark."""
