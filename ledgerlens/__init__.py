"""Data-quality analytics for header/line tables, expressed as Spark DataFrames."""
