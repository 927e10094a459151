"""Glossarium: corpus analytics over speech and text tables, written for Spark's DataFrame engine."""
