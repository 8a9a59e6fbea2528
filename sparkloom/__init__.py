"""sparkloom: a Spark-native engine for hybrid retrieval and text analytics."""

__version__ = "0.1.0"
