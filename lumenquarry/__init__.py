"""A Spark-first analytics engine for evidence retrieval and reasoning."""
