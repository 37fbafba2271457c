"""Features kept up to date from a stream."""

from riskloom.streaming.trailing import StreamRun, run_available, trailing_stream

__all__ = ["StreamRun", "run_available", "trailing_stream"]
