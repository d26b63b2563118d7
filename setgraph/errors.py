"""Errors of the library."""


class SetGraphError(ValueError):
    """A request that a hypergraph can't serve."""


class TooLargeError(SetGraphError):
    """Data that would have to fit on the driver is larger than the stated bound."""


class NonUniformError(SetGraphError):
    """Edges of different sizes where one size is needed."""
