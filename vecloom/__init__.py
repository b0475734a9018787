"""Vector quantization and similarity search on Spark DataFrames."""
