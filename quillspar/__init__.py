"""Quillspar: evidence analytics for document collections, written for Spark.

Operators are plain functions over DataFrames; queries are registered with
the SQL text that states the same result for another engine.
"""
