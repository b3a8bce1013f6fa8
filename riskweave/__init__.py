"""Transaction-risk analytics and training-data operators on PySpark."""
