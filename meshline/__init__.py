"""A property-graph analytics engine on PySpark: graphs are DataFrames, operators are Spark plans."""

__version__ = "0.1.0"
