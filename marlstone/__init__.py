"""Document retrieval and analytics engine built on Spark DataFrames."""
