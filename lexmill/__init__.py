"""Text retrieval and mining on Spark DataFrames."""
