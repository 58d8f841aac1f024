"""Readers (records, text, CSV, JSON arrays, vocab, neighbours) and sinks."""
