"""Structured Streaming forms of the stateful operators (EP2)."""

from queryforge.streaming.episodes import fold_stream, run_stream_fold, stream_idle_sessions

__all__ = ["fold_stream", "run_stream_fold", "stream_idle_sessions"]
