"""quernstone: a Spark-native engine for the reliability analytics of tool-using agents."""

__version__ = "0.1.0"
