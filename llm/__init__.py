"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``__spark_entry__.py`` registers its queries
only when it can be imported.
"""
