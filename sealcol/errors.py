"""Error codes. Messages never carry values or keys."""

from __future__ import annotations

CODES = (
    "UNKNOWN_FORMAT_VERSION", "SUITE_NOT_ALLOWED", "KEY_UNAVAILABLE", "AAD_MISMATCH", "TAG_INVALID", "COMMITMENT_INVALID",
    "NOT_CIPHERTEXT", "MODE_VIOLATION", "LENGTH_EXCEEDED", "SUITE_PROVISIONAL",
)
#: Codes of one engine's own making, and those that only a backfill records.
LOCAL_CODES = ("CONFIGURATION_ERROR", "INVALID_ARGUMENT")
BACKFILL_CODES = ("RENDERING_REFUSED", "CONTEXT_UNAVAILABLE", "INTERNAL")
OK, PLAIN = "OK", "PLAIN"


class SealError(Exception):
    """An error with one of the codes above."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class ConfigurationError(SealError, ValueError):
    def __init__(self, message: str):
        super().__init__("CONFIGURATION_ERROR", message)


class InvalidArgument(SealError, TypeError):
    def __init__(self, message: str):
        super().__init__("INVALID_ARGUMENT", message)


class NotSupported(SealError):
    """A shape over sealed columns that would silently give a wrong answer."""

    def __init__(self, message: str):
        super().__init__("NOT_SUPPORTED", message)
