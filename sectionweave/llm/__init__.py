"""Operators of a training-data pipeline over a corpus table; nothing else in the package imports them."""
