"""Structured Streaming form of the stateless chain."""
from facetspark.streaming.file_stream import run_stream  # noqa: F401
