"""Change feeds kept up to date with Structured Streaming."""
