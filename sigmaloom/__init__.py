"""sigmaloom: statistical quality analytics as Spark DataFrame operators."""
