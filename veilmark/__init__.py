"""De-identification and training-data analytics as Spark DataFrame operators."""
