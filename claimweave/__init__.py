"""Claimweave: evidence analytics and training-data operators on PySpark."""
