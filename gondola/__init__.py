"""gondola: shelf-vision and training-data analytics on Spark DataFrames."""
