"""siftlight: photo-catalog review and corpus preparation on Spark DataFrames."""
