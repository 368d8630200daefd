"""Tessella: text-corpus analytics on PySpark DataFrames."""
