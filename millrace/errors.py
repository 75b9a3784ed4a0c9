"""Errors, by when they are found and whether a scheduler may try again."""


class PlanError(ValueError):
    """A script is refused before any row is read."""

    def __init__(self, message: str, at: tuple[str, int, int] | None = None):
        self.message, self.at = message, at
        super().__init__(f"{at[0]}:{at[1]}:{at[2]}: {message}" if at else message)


class Thrown(PlanError):
    """A THROW statement fired; never worth a retry."""


class RunError(RuntimeError):
    """A run failed; ``transient`` if the same run may succeed later."""

    def __init__(self, message: str, transient: bool = False):
        super().__init__(message)
        self.transient = transient


def is_transient(e: BaseException) -> bool:
    """Whether an error is of the kind that goes away: refused or broken connections, timeouts, busy servers."""
    if isinstance(e, PlanError):
        return False
    if isinstance(e, RunError):
        return e.transient
    if isinstance(e, (ConnectionError, TimeoutError)):
        return True
    text = str(e).lower()
    return any(x in text for x in ("connection refused", "connection reset", "timed out", "timeout", "too many connections", "deadlock", "temporarily unavailable", "503"))
