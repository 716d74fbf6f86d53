"""Document retrieval, evaluation and corpus processing on DataFrames."""
