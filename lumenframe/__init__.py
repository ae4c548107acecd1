"""lumenframe: vision-inference results as DataFrames, on Spark."""
