"""Style-aware recommendation analytics as PySpark DataFrame jobs."""
