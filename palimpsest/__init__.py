"""palimpsest: analytics over archives of versioned documents, on Spark DataFrames."""

__version__ = "0.1.0"
