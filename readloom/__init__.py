"""Read-level mixture analytics on Spark."""
