"""Connected components, as the rest of the package has them."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
