"""Retrieval over document collections, and its evaluation, as Spark jobs."""
