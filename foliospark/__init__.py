"""A document evidence engine on Spark: files in, queryable evidence out."""

__version__ = "0.1.0"
