"""The kinds of failure that callers can tell apart."""


class MillraceError(Exception):
    """Any failure of this library."""


class StoreError(MillraceError):
    """A file or listing can't be read or written."""


class IndexError_(MillraceError):
    """A pattern, vector or index is malformed."""


class PlanError(MillraceError):
    """A stage of a plan failed."""


class ConfigError(MillraceError):
    """An address or setting is wrong."""


class RequestError(MillraceError):
    """The arguments of a verb contradict each other."""
