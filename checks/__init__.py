"""Checks of the jobs on the driver's tables: views, queries and their SQL counterparts."""
