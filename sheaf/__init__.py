"""Document-intelligence operators on Spark DataFrames."""
