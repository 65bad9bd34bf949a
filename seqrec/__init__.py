"""PySpark-native data engine for sequential and serendipity-aware recommendation."""

__version__ = "0.1.0"
