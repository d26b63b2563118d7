"""setgraph: hypergraph analytics on Spark DataFrames."""
