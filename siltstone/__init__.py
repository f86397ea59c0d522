"""File-manifest analytics on Spark."""
