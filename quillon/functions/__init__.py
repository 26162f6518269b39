"""Column expressions: query words, detectors, messages."""
