"""Price-intelligence analytics as Spark DataFrame operators."""
