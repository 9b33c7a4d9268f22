"""Location-history and street-network analytics on Spark DataFrames."""
