"""Documents to Markdown (MD1 to MD14)."""

from .formats import can_convert, convert, converted, supported_formats

__all__ = ["can_convert", "convert", "converted", "supported_formats"]
