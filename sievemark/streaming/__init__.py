"""Structured Streaming forms of the moderation operators."""
