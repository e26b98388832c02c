"""Errors of the front end."""


class QueryError(ValueError):
    """A statement that can't be run as written."""


class UnsupportedSyntax(QueryError):
    """Syntax that the dialect rejects."""


class UnknownRelation(QueryError):
    """A relation name that leads to no data."""


class UnknownFunction(QueryError):
    """A function name that the dialect lacks."""


class NotAllowed(PermissionError):
    """A statement or relation that the session's roles may not use."""
