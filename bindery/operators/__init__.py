"""Operators over solutions (bags of variable bindings)."""

from .solutions import Solutions, Var

__all__ = ["Solutions", "Var"]
