"""Analytics on position-ordered data, expressed in Spark DataFrames."""
