"""Errors of the query surface."""


class TermloomError(Exception):
    """Base of all errors raised here."""


class QuerySyntaxError(TermloomError, ValueError):
    """A query that neither language accepts."""


class EmptyTermError(QuerySyntaxError):
    """A query word in which the analyzer finds no token."""


class BuilderError(TermloomError, ValueError):
    """A builder clause with too few terms, or nothing to build."""


class UnknownIndexError(TermloomError, KeyError):
    """No index is registered under that name."""
