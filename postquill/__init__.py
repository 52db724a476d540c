"""postquill: message analytics and retrieval on Spark DataFrames."""
