"""meterlake: usage-ledger analytics as PySpark DataFrame operators."""
