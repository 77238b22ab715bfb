"""Evidence retrieval over label documents, written as Spark DataFrame jobs."""
