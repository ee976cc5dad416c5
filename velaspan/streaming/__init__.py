"""Structured Streaming forms of detection."""
