"""wardlight: security-desk analytics and corpus preparation on Spark DataFrames."""
