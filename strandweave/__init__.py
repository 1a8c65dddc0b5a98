"""Sequence assembly as Spark dataflow."""
