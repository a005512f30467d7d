"""Structured Streaming jobs. State is bounded by a watermark in every stateful query."""
