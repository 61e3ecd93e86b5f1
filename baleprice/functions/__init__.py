"""Fixed values and column helpers shared by the operators."""
