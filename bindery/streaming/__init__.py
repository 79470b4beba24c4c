"""Patterns over streams."""

from .patterns import watch, windowed_counts

__all__ = ["watch", "windowed_counts"]
