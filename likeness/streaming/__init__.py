"""Structured Streaming: index passes and corrections as they arrive."""
