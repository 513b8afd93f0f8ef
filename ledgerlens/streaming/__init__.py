"""Structured Streaming: score newly arriving contracts against a snapshot."""
