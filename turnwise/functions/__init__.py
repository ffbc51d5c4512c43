"""Column-level building blocks. Everything here is a Column -> Column expression."""
