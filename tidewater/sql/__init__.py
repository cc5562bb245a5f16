"""The SQL dialect: text to syntax trees to relations."""

from .binder import Binder
from .parser import parse

__all__ = ["Binder", "parse"]
