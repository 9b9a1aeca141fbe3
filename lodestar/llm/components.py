"""Connected components, which lodestar.operators has."""

from lodestar.operators.components import connect

__all__ = ["connect"]
