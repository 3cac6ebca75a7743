"""One exception for all rejections; `code` says which."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
