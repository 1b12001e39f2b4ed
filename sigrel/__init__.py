"""sigrel: relationships between event and signal streams as Spark DataFrame operators."""
