"""ctxspark: a Spark-native code-context analytics and hybrid retrieval engine."""

__version__ = "0.1.0"
