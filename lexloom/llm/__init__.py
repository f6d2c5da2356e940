"""Operators for large-scale training-data preparation (nothing else in lexloom imports this)."""
