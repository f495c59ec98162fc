"""What the operators of this subpackage take from the core."""

from ..functions.arrow import arrow_map, materialize, shared_path, table

__all__ = ["arrow_map", "materialize", "shared_path", "table"]
