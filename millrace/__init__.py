"""millrace: a Spark-first analytics engine for a fixed-schema sales fact table."""
