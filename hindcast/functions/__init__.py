"""Column-level helpers: calendar arithmetic, safe scalars, identifiers and JSON parameters."""
