"""Structural text analytics over whole tables, on Spark."""
