"""Queries by name; importing the modules registers them."""
