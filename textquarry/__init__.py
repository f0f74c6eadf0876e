"""A text analytics engine on Spark DataFrames."""
