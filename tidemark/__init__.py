"""Daily-bar market analytics expressed as PySpark DataFrame operators."""
