"""Positions and market values on PySpark, batch and streaming."""
