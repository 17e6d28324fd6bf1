"""bindscape: Spark-native preparation, profiling, screening and evaluation of
drug-target affinity data. See README.md for the operator map."""

__version__ = "0.1.0"
