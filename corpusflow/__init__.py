"""corpusflow: site corpora and retrieval as Spark DataFrame operators."""
