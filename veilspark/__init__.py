"""Sensitive-data detection and sanitisation as DataFrame transformations."""
