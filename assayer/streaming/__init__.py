"""Order-free scores of a stream of predictions."""

from assayer.streaming.scores import windowed_scores

__all__ = ["windowed_scores"]
