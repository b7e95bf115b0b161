"""Structured Streaming: camera frames and payload intake."""
