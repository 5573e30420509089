"""quillspan: a PySpark-native engine for interval, sequence, signal and corpus analytics."""

__version__ = "0.1.0"
