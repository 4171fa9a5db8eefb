"""Spark-native analytics for instance-annotation data.

Every operator is a plain ``DataFrame -> DataFrame`` function; Catalyst picks
the physical plan.  Sub-packages:

``functions``   column expressions (strings, geometry, vectors)
``sources``     readers (nested JSON exports, polygon label files, tables)
``sinks``       writers
``operators``   relational operators (features, pairs, distances, evaluation...)
``plans``       query catalogue bound to the test tables, with its SQL twins
``streaming``   Structured Streaming forms of the incremental operators
"""

__version__ = "0.1.0"
