"""quern: document and data operators for Spark DataFrames."""
