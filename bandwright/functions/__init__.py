"""Column functions: no actions, no shuffles, usable in any projection."""
