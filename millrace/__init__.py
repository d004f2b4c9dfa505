"""millrace: data preparation, model evaluation, triple and graph analytics on Spark DataFrames."""
