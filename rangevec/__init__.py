"""Range-filtered vector search over changing data, built on Spark DataFrames."""

__version__ = "0.1.0"
