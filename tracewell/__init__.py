"""Event and asset investigation analytics as Spark DataFrame operators."""
