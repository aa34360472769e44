"""A Spark-first SQL analytics engine."""
