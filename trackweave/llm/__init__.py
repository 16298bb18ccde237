"""Operators that prepare large text collections for training."""
