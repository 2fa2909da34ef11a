"""A Spark-first engine for declarative document transformation and analytics."""
