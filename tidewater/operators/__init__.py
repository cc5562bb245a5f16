"""Operators on relations."""

from .basic import filter_, project, union
from .join import JoinKind, window_join
from .windowed import AGGREGATES, Aggregate, Window, assign, sliding, tumbling, window_aggregate

__all__ = ["AGGREGATES", "Aggregate", "JoinKind", "Window", "assign", "filter_", "project", "sliding", "tumbling", "union", "window_aggregate", "window_join"]
