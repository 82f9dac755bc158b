"""Context analytics on Spark: code graphs, vectors, change impact and retrieval quality as DataFrames."""
