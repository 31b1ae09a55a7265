"""Connected components of links between documents; see `operators.components`."""

from curatorium.operators.components import components

__all__ = ["components"]
