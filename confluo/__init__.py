"""confluo: config-driven entity federation on Spark DataFrames."""
