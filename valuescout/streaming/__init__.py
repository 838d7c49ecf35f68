"""The same cleaning steps as Structured Streaming jobs."""
