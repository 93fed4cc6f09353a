"""docatlas: API-documentation analytics as Spark jobs."""
