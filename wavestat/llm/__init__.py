"""Training-data operators (see README)."""
