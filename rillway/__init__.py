"""Event-warehouse and corpus analytics as plain DataFrame -> DataFrame functions on PySpark."""
