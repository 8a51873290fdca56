"""citadex: a Spark-native document-corpus and hybrid-retrieval engine."""

__version__ = "0.1.0"
