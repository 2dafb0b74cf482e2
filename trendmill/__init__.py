"""Video-trending analytics expressed as Spark DataFrame jobs."""
