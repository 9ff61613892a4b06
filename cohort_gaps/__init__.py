"""Two-group gap analysis over unit-by-period panels, written as Spark DataFrame jobs."""
