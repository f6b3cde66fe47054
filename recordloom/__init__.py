"""recordloom: document ingestion and record normalisation as Spark DataFrame jobs."""
