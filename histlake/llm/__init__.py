"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it can be imported.
"""
