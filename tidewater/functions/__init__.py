"""Typed scalar expressions and the registry of scalar functions."""

from .expressions import Call, Const, Expr, Field, cast, const, field
from .scalar import REGISTRY, function

__all__ = ["REGISTRY", "Call", "Const", "Expr", "Field", "cast", "const", "field", "function"]
