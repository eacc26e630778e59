"""Errors that are raised while a plan is built."""


class LexigraphError(Exception):
    """Any error of this library."""


class InvalidArgument(LexigraphError):
    """An option or parameter outside its range."""


class InvalidDictionary(LexigraphError):
    """A dictionary, tagset or rule file that breaks its format."""


class NotFound(LexigraphError):
    """A lexicon that is in none of the search paths."""


class Unsupported(LexigraphError):
    """A use for which the lexicon was not opened."""
