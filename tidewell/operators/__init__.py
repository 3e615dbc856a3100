"""General data-processing operators; each takes DataFrames and returns DataFrames."""
