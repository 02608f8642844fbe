"""Geodata governance, geometry and delivery operators expressed as Spark plans."""
