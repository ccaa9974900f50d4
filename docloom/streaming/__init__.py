"""Structured Streaming over job and user events."""
