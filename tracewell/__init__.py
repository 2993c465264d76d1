"""tracewell: pairwise similarity and provenance analytics on Spark DataFrames."""
