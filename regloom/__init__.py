"""regloom: a PySpark-native engine for regulatory document analytics."""

__version__ = "0.1.0"
