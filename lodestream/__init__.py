"""lodestream: product-data and request-log analytics as Spark DataFrame operators."""
