"""Loaders: each turns a URI into a DataFrame with the dialect's types."""
