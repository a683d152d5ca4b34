"""Event-catalogue analytics as Spark jobs."""
