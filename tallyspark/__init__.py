"""Spark-native analytics over pull-request feedback: operators, sources, functions, plans and streaming twins."""
