"""Training-data length profiling and table operators on Spark DataFrames."""
