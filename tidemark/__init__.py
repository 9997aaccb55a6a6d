"""Tidemark: point-in-time customer features, evaluation and studies as Spark plans."""
