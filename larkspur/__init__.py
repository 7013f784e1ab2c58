"""Larkspur: catalog analytics and training-data preparation on PySpark."""
