"""End-to-end plans that put the operators together."""
