"""What the engine refuses, and why."""


class QueryNotSupported(Exception):
    """The shape of the query has no defined meaning; the message names it."""


class ConcurrencyConflict(Exception):
    """A version, revision or key is no longer what the writer saw."""


class StreamExists(ConcurrencyConflict):
    """A stream was to be started that is there already."""


class BoundaryConflict(ConcurrencyConflict):
    """Events that a decision depended on were added before it was committed."""
