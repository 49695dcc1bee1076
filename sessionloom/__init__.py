"""Session analytics on Spark: traces to features, episodes, pair scores and metrics."""

__version__ = "0.1.0"
