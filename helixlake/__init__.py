"""helixlake: a PySpark-native analytics engine for molecular sequence tables."""

__version__ = "0.1.0"
