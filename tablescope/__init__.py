"""Tablescope: a PySpark-native engine for evaluating structured-table extraction."""
