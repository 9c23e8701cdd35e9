"""weftline: web-corpus analytics expressed as Spark DataFrames, SQL and Structured Streaming."""
