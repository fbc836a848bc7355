"""Connected components of an edge table; the library's own operator under the name that is used here."""

from leadloom.operators.resolve import connected as components

__all__ = ["components"]
