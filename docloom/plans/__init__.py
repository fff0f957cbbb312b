"""Logical plans of the registered queries, one module per area."""
