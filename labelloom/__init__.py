"""Build, check and score labelled instruction data with Spark DataFrames."""
