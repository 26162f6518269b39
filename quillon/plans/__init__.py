"""Whole query plans put together from operators."""
