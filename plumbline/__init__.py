"""Typed, constrained records on Spark: declare, validate, generate, read, write, analyse."""
