"""Connected components, from the library's operators."""

from tidemark.operators.components import connected_components

__all__ = ["connected_components"]
