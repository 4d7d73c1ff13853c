"""Job-posting analytics on Spark DataFrames."""
