"""Readers of tools' output: declared by pattern, applied as column expressions and window functions."""

from loomline.readers.detect import detect
from loomline.readers.registry import READERS, Reader, apply, assign

__all__ = ["READERS", "Reader", "apply", "assign", "detect"]
