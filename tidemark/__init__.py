"""Point-in-time prediction-market analytics on Spark DataFrames."""
