"""Drug-safety case-report analytics as PySpark DataFrame jobs."""
