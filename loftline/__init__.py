"""Listing analytics as Spark DataFrame transformations."""
