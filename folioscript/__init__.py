"""Corpus-to-script analytics as PySpark DataFrame operators."""
