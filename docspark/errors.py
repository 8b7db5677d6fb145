"""Status codes of the engine's calls."""

from __future__ import annotations

#: The codes by name. CONFLICT is this engine's own, of two commits that change the same documents.
STATUSES = (
    "OK", "INVALID_ARGUMENT", "NOT_FOUND", "ALREADY_EXISTS", "IO", "CORRUPT", "UNSUPPORTED", "BUSY", "DENIED", "TOO_LONG",
    "TOO_LARGE", "ENCRYPTED", "MODEL_MISMATCH", "CANCELLED", "OUT_OF_MEMORY", "INTERNAL", "CONFLICT",
)


class EngineError(Exception):
    def __init__(self, status: str, message: str):
        if status not in STATUSES:
            raise ValueError(status)
        super().__init__(message)
        self.status = status


def require(condition: bool, message: str, status: str = "INVALID_ARGUMENT") -> None:
    if not condition:
        raise EngineError(status, message)
