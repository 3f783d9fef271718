"""Document analytics on Spark: quality, assembly, chunking, views, vectors, retrieval metrics."""
