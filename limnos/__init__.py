"""Water-quality analytics as PySpark DataFrame operators.

Operators are plain functions ``DataFrame -> DataFrame``; they can be chained with
``df.transform``. See README.md for the map from topic to module.
"""
