"""A keyed, versioned log on Spark DataFrames."""
