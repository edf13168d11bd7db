"""Connected components, shared with topics."""

from ..operators.graph import components  # noqa: F401
