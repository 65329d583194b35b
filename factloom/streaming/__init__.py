"""Incremental evaluation of facts that keep arriving."""
