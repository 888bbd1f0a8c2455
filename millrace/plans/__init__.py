"""The named queries, a module a family."""
