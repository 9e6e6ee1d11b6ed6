"""Identity-evidence analytics as PySpark DataFrame jobs."""
