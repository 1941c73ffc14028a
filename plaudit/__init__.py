"""Review analytics as Spark DataFrame jobs."""
