"""Fluent topologies that compile to DataFrames, and the application around them."""
