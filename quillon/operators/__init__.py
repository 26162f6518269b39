"""Operators over chunks, claims, events and capability tables."""
