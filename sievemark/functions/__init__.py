"""Column -> Column building blocks; nothing here triggers a Spark job."""
