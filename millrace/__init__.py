"""Document analytics on PySpark."""

from .engine import Database

__all__ = ["Database"]
