"""Comparative gene-structure analytics, and their generic forms, on Spark DataFrames."""
