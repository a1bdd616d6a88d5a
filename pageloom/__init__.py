"""Page analytics on Spark: pages to graphs, extraction, rule portfolios and delivery hygiene."""

__version__ = "0.1.0"
