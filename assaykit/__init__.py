"""assaykit: data ingestion, profiling, validation and quality analytics on Spark DataFrames."""
