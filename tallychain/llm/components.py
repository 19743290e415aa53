"""Connected components, as the library has them."""

from tallychain.operators.components import components

__all__ = ["components"]
