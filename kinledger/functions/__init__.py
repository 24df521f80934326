"""Column builders: pure, no I/O, no session."""
