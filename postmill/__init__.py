"""Postmill: policy- and dialogue-text analytics on PySpark."""
