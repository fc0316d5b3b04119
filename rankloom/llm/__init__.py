"""Operators that prepare text and record sets for training data. Nothing else in the library imports this."""
