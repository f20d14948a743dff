"""quire: page-stream analytics on Spark DataFrames."""
