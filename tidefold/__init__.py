"""tidefold: a Spark-native engine for moving, reconciling and analysing relational data."""

__version__ = "0.1.0"
