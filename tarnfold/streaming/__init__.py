"""Structured Streaming: sources, windows, watermarks and keyed state."""

from tarnfold.streaming.state import bloom_state, reservoir_state
from tarnfold.streaming.stream import drain, draws, events_stream, sessions, sliding, unique_within

__all__ = ["bloom_state", "drain", "draws", "events_stream", "reservoir_state", "sessions", "sliding", "unique_within"]
