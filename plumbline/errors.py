"""What can go wrong, by cause."""

from __future__ import annotations


class PlumblineError(Exception):
    """Base of all."""


class ConfigurationError(PlumblineError):
    """The caller left out or mixed up something that an action needs."""


class ParseError(PlumblineError):
    """An expression, pattern or literal cannot be read."""

    def __init__(self, what: str, text: str, at: int | None = None, why: str = ""):
        super().__init__(f"Error parsing {what} '{text}'" + (f" near index {at}" if at is not None else "") + (f": {why}" if why else ""))
        self.at = at


class ExpressionParseError(ParseError):
    pass


class PatternParseError(ParseError):
    pass


class ExpressionEvaluationError(PlumblineError):
    """Overflow, division by zero, or a power that is no integer."""


class PatternEvaluationError(PlumblineError):
    pass


class VariableNotFound(PlumblineError):
    pass


class ValueNotFound(PlumblineError):
    pass


class TypeMismatch(PlumblineError):
    pass


class InvalidConstraint(PlumblineError):
    """A constraint that makes no sense whatever the value."""


class ImpossibleToSatisfy(PlumblineError):
    """Constraints that exclude each other."""


class GenerationError(PlumblineError):
    """No value was found within the allowed attempts."""

    def __init__(self, message: str, retryable: bool = True):
        super().__init__(message)
        self.retryable = retryable


class ValidationError(PlumblineError):
    pass


class ReadError(PlumblineError):
    """Text that does not follow its layout."""

    def __init__(self, message: str, line: int = 1, token: int = 1, column: int = 1, snippet: str = ""):
        super().__init__(f"Line {line}, token {token} (col {column}): {message}" + (f"\n{snippet}" if snippet else ""))
        self.reason, self.line, self.token, self.column, self.snippet = message, line, token, column, snippet


class WriteError(PlumblineError):
    pass
