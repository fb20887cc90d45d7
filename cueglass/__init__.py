"""Screen-text resolution and transcript analytics as Spark jobs."""

from cueglass.config import Limits

__all__ = ["Limits"]
