"""Sources and sinks by type name; both registries are open to users."""

from .generator import generator
from .readers import SOURCES, read
from .sinks import SINKS, checksum, csv_lines, write

__all__ = ["SINKS", "SOURCES", "checksum", "csv_lines", "generator", "read", "write"]
