"""Failures that callers tell apart."""

from __future__ import annotations


class EngineError(Exception):
    """Any failure of the engine."""


class AdapterError(EngineError):
    """Something outside failed; trying again may help."""


class RateLimited(AdapterError):
    def __init__(self, message: str, retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class BudgetExceeded(EngineError):
    """A call would go beyond a ceiling."""


class NonRetryable(EngineError):
    """Trying again can't help."""


class StepNotReplayable(EngineError):
    """A step that isn't idempotent was interrupted."""


class ScreeningRejected(NonRetryable):
    def __init__(self, path: str, reason: str):
        super().__init__(f"{path}: {reason}")
        self.path, self.reason = path, reason
