"""Source-preserving text context management and offline evaluation on Spark DataFrames."""

__version__ = "0.1.0"
