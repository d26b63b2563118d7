"""Operators on hypergraphs and on the graphs derived from them."""
