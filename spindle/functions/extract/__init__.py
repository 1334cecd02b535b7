"""Extractors: from the content of a file to entities, edges, calls and observations."""

from .registry import EXTRACTORS, extract, format_of

__all__ = ["EXTRACTORS", "extract", "format_of"]
