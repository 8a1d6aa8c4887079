"""Structured Streaming: fits whose normal equations are additive sums kept as state."""
