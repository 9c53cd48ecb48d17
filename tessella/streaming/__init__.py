"""Structured Streaming forms of the mergeable operators (an extension)."""
