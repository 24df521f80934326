"""Operators for training-data work; nothing outside this folder imports it."""
