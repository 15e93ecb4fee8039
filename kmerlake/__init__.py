"""K-mer based variant analytics on Spark DataFrames."""
