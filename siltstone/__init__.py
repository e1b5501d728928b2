"""Web-content analytics on Spark: page, text, dedup, relevance and log jobs as DataFrame operators."""

__version__ = "0.1.0"
