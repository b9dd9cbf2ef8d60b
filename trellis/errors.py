"""Errors of the engine."""


class CypherError(ValueError):
    """Base of all errors that a query can cause."""


class CypherSyntaxError(CypherError):
    """The text is no query."""

    def __init__(self, message: str, text: str = "", at: int = 0):
        line = text.count("\n", 0, at) + 1
        column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} (line {line}, column {column})" if text else message)


class CypherSemanticError(CypherError):
    """The query refers to what isn't there or mixes what can't be mixed."""


class LimitExceededError(CypherError):
    """A configured ceiling was passed."""
