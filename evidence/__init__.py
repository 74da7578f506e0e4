"""Audit labelled datasets and analyse classifier evidence with PySpark."""
