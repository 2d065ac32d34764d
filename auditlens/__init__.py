"""auditlens: bulk auditing of hospital insurance claims on Spark DataFrames."""
