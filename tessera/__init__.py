"""Vector-collection, text and ingestion analytics as Spark plans."""
