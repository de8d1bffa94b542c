"""Parliamentary open-data analytics as ordinary Spark batch jobs."""
