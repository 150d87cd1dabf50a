"""Connected components, as the engine's own operator gives them."""

from pluvion.operators.graph import components  # noqa: F401
