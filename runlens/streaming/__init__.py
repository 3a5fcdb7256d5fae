"""Log extraction as Structured Streaming."""
