"""Document-structure analytics on Spark: operators from DataFrame to DataFrame."""
