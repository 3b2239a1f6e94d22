"""veldspar: a PySpark-native entity-resolution and evaluation engine."""
