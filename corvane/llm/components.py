"""Connected components of an edge table; the library's own."""

from corvane.operators.components import components

__all__ = ["components"]
