"""cutline: leak-free point-in-time analytics as Spark DataFrame operators."""
