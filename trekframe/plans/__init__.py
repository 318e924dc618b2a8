"""Registered queries of the journey operators with their SQL."""
