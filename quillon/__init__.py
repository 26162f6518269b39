"""Evidence resolution, event-state replay and training-data operators as plain Spark plans."""
