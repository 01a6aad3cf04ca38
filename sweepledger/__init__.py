"""Spark jobs that audit large release and dependency collections."""
