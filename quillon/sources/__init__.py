"""Tables, corpora and event sources."""
