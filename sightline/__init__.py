"""Multi-camera tracking analytics on Spark DataFrames and Structured Streaming."""
