"""Operators for preparing training data: one module for each operator, and queries.py that registers them."""
