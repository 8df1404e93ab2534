"""corpusmill: DataFrame-first operators for building and auditing training corpora."""
