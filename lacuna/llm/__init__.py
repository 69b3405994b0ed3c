"""Operators of a training-data pipeline, one module each.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when the package is there.
"""
