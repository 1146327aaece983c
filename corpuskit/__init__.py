"""corpuskit: DataFrame jobs for source-code and manual corpora on Spark."""
