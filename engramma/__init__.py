"""A Spark-first analytics engine for conversation and document memory."""
