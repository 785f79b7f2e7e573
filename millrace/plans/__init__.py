"""Queries over the driver's tables, built from the library's operators."""
