"""Operators for preparing training data, each built on Spark DataFrames; nothing else in the library imports them."""
