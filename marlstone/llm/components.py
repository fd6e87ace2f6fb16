"""Connected components, as the engine's graph operators find them."""

from marlstone.operators.graph import connected_components

__all__ = ["connected_components"]
