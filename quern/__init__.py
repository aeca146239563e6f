"""quern: document-query matching and record normalisation on Spark DataFrames."""
