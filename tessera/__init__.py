"""Tessera: a PySpark-native SQL analytics engine over Parquet."""

__version__ = "0.1.0"
