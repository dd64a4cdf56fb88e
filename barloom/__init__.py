"""End-of-day market data on Spark: ingest, validate, merge, and read back."""
