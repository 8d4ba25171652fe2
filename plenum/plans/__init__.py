"""Registered queries over the given tables, with their SQL oracles."""
