"""Advertising and traffic-exchange analytics as PySpark DataFrame transformations."""
