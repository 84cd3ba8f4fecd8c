"""Matching plans over property graphs."""
