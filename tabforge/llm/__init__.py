"""Operators of a training-data pipeline, as Spark jobs.

Each module holds one operator with a general interface over DataFrames; ``queries.py`` holds the thin
queries over the driver tables.  Nothing else in the library imports this subpackage.
"""
