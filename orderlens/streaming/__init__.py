"""The same operators on unbounded input."""

from .jobs import (carry_available, read_stream, run_available, run_updates, stream_carry_context, stream_rates,
                   stream_score, stream_screen)

__all__ = ["carry_available", "read_stream", "run_available", "run_updates", "stream_carry_context", "stream_rates",
           "stream_score", "stream_screen"]
