"""recallgrid: a PySpark-native analytics engine for spaced-repetition study data."""

__version__ = "0.1.0"
