"""Readers of tables."""

from .tables import load

__all__ = ["load"]
