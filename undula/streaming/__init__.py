"""Structured Streaming forms of the operators that stream."""
