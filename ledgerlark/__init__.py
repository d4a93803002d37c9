"""Contract-driven data quality and data integration on Spark DataFrames."""
