"""millrace: a PySpark-native curation and analytics engine for syndicated articles."""

__version__ = "0.1.0"
