"""Column-level building blocks: fixed values, scalar rules and array maths."""
