"""Spark-first analytics for pretraining corpora and fleet telemetry."""
