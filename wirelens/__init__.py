"""Threat-news analytics as Spark jobs.

Every operator is a function from DataFrame (or Column) to DataFrame (or Column).
Nothing here collects an unbounded table; wall-clock time is always the ``as_of``
argument, so a rerun over the same tables gives the same rows.
"""
