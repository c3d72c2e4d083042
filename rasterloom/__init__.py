"""Image-codec analytics on Spark DataFrames."""
