"""Operators of the dataflow engine."""
