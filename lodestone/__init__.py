"""Lodestone: a source-corpus and document analytics engine on PySpark."""
