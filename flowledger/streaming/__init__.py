"""Incremental steps over streams. An extension: bounded runs are what the engine is about."""
