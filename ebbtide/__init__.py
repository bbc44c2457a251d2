"""Spark-first analytics for activity records, weekly panels and large text corpora."""
