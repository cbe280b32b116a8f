"""Panel pipelines, each a function from DataFrames to DataFrames."""
