"""Flowledger: incremental, content-addressed dataflow expressed as Spark DataFrame programs."""
