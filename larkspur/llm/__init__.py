"""Operators for preparing training data: text, vectors and web archives at corpus scale."""
