"""Graph and time-series analytics compiled to Spark DataFrames."""
