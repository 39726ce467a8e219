"""Incremental scoring of response files as they arrive (Structured Streaming)."""

from traitgrid.streaming.live_scores import live_moments, response_stream, start_live_scores  # noqa: F401
