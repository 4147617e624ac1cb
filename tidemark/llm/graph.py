"""Connected components, from the library."""

from __future__ import annotations

from tidemark.operators.regions import components

__all__ = ["components"]
