"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, but for __spark_entry__.py (if it is there) and corpus_pipeline.py."""
