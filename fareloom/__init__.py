"""Price-observation analytics and a base-period price index, written as Spark DataFrame jobs."""
