"""Long-read analytics and corpus processing on PySpark."""
