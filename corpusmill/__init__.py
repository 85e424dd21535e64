"""corpusmill: corpus curation operators for PySpark."""
