"""Building hypergraphs from tables, Python collections, matrices, JSON documents and text files."""
