"""Structured Streaming variants of the stages whose state is bounded by time."""
