"""Legal-practice analytics on PySpark."""
