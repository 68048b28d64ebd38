"""Registered queries over the given tables, and SQL for those that SQL can express."""
