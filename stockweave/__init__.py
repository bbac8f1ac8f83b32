"""Bill-of-materials analytics on Spark."""
