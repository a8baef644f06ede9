"""docspark: a PySpark-native document-processing engine.

Every operator is a ``DataFrame -> DataFrame`` function with an explicit schema; see README.md for the map of modules.
"""
