"""Operators of a training-data pipeline: quality, duplicates, leaks, packing, archives, token files.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries
(:mod:`footfall.llm.queries`) only when it can be imported.
"""
