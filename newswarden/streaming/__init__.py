"""Structured Streaming over the same operators: a stream's result is what the batch gives."""
