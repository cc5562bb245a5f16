"""Running streaming queries."""

from .runner import Ends, late_rows, run, state_dir, to_table

__all__ = ["Ends", "late_rows", "run", "state_dir", "to_table"]
