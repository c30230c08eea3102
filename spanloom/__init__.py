"""Timed-interval analytics as DataFrame transforms.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame
transforms), ``sources`` (readers and writers), ``plans`` (derived tables and
the query catalog) and ``streaming`` (Structured Streaming forms).
"""
