"""Implicit-feedback and bundle analytics on PySpark DataFrames."""
