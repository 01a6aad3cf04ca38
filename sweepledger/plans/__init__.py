"""Audits over the given tables: each joins operators into one Spark plan."""
