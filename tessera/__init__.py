"""tessera: joins, radix partitioning, scans and aggregation expressed on Spark DataFrames."""

__version__ = "0.1.0"
