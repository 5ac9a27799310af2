"""marlstone: versioned, hierarchical code classifications on Spark DataFrames."""

__version__ = "0.1.0"
