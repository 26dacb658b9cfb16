"""Document analytics on Spark: recognise, parse, render, link, crawl, score."""

__version__ = "0.1.0"
