"""Column functions and small rules that operators take as parameters."""
