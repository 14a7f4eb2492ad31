"""Structured failures: a code decides its layer and its exit code; outer layers win."""

from __future__ import annotations

from enum import Enum

#: Layers from the outermost, and codes by layer.
LAYERS = {
    "transport": ("HTTP_STATUS", "HTTP_TIMEOUT", "HTTP_TRUNCATED", "UPSTREAM_ERROR_PAGE"),
    "archive": ("ZIP_CORRUPT", "ZIP_NO_CSV"),
    "decode": ("CSV_DECODE", "SOURCE_CONTROL_CHAR"),
    "schema": ("SCHEMA_MISMATCH", "ROW_WIDTH"),
    "content": ("ZERO_ROWS", "ROWCOUNT_DROP", "IDENTITY_COLLISION", "ID_TRUNCATION_COLLISION"),
    "publish": ("INTEGRITY_DIGEST", "PROMOTION_FAILED", "BASELINE_MOVED"),
}
CODES = [code for codes in LAYERS.values() for code in codes]
Code = Enum("Code", [(c, c) for c in CODES], type=str)
FIRST_EXIT = 10


class SnapshotError(Exception):
    """A defect of the input or of publishing; nothing is published after it."""

    def __init__(self, code: str, message: str = "", **detail) -> None:
        super().__init__(message or code)
        self.code = Code(code)
        self.detail = detail

    @property
    def layer(self) -> str:
        return next(k for k, codes in LAYERS.items() if self.code.value in codes)

    @property
    def exit_code(self) -> int:
        return FIRST_EXIT + CODES.index(self.code.value)


def outermost(errors: list[SnapshotError]) -> SnapshotError:
    """The error of the outermost layer; the first raised among equals."""
    return min(errors, key=lambda e: list(LAYERS).index(e.layer))
