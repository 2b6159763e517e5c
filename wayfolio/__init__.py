"""wayfolio: places and texts analytics as PySpark DataFrame jobs."""
