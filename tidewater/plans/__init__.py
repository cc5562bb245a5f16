"""Relations: a DataFrame with declared types."""

from .relation import Relation

__all__ = ["Relation"]
