"""Answers on streams, a budget for each batch."""

from .batches import answer_each_batch

__all__ = ["answer_each_batch"]
