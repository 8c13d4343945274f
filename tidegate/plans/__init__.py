"""Plan shapes shared by the operators: ordered prefixes and two-dimensional visibility."""
