"""Query plans: the named queries bound to driver tables, and their SQL oracles."""
