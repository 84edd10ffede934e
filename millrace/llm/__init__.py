"""Operators for building training corpora at scale.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries only if it can be imported.
"""
