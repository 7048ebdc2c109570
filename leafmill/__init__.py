"""Spark-native analytics over fragmented long-form text.

Sub-packages: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame), ``sources`` (readers and sinks),
``plans`` (registered queries and their SQL twins) and ``streaming`` (Structured Streaming forms).
"""
