"""Operators for training data: similarity, term statistics, clean-up, encoding and leaks."""
