"""Security-log analytics on Spark: DataFrame-first operators, sources and a pipe language."""
