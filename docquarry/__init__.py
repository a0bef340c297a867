"""Corpus ingest, chunking, vector retrieval and semantic caching as Spark jobs."""
