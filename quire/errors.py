"""Errors raised before a plan is built."""

from __future__ import annotations


class EngineError(Exception):
    """A refused request: a stable ``code``, a message, and facts that help to mend it."""

    def __init__(self, code: str, message: str, **extra):
        super().__init__(message)
        self.code, self.message, self.extra = code, message, extra

    def envelope(self) -> dict:
        return {"error": self.message, "code": self.code, **self.extra}
