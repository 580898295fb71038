"""Connected components; see operators/components.py."""

from corploom.operators.components import _large_star, components, own_exchange

__all__ = ["_large_star", "components", "own_exchange"]
