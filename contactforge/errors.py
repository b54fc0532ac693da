"""Exceptions of the library."""


class ContactError(Exception):
    """Base of all errors that a user can cause."""


class NoCutSites(ContactError):
    """No segment of the community has a cut site."""


class SequenceError(ContactError):
    """Sequences are missing, repeated or hold symbols that can't be read."""


class SingleReplicon(ContactError):
    """Another replicon was asked for in a cell that has just one."""


class OutOfBounds(ContactError):
    """A position or value outside its range."""


class EmptyCommunity(ContactError):
    """Nothing is registered."""
