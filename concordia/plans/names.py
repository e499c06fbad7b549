"""Target names: at most 63 bytes, no two alike in a schema (HSH5, PLN10)."""

from __future__ import annotations

import hashlib

LIMIT = 63


def size(name: str) -> int:
    return len(name.encode())


def shortened(name: str, limit: int = LIMIT) -> str:
    """A name that fits: its beginning, cut between characters, and eight digits of its hash."""
    if size(name) <= limit:
        return name
    tail = "_" + hashlib.sha256(name.encode()).hexdigest()[:8]
    return name.encode()[: limit - len(tail)].decode(errors="ignore") + tail


class Namespace:
    """Names taken in one schema; a second comer is named after its table, then numbered."""

    def __init__(self) -> None:
        self.taken: set[str] = set()

    def claim(self, name: str, table: str) -> str:
        for n in self._tries(name, table):
            if n not in self.taken:
                self.taken.add(n)
                return n
        raise AssertionError

    @staticmethod
    def _tries(name: str, table: str):
        yield shortened(name)
        longer, i = f"{name}_{table}", 2
        yield shortened(longer)
        while True:
            yield shortened(f"{longer}_{i}")
            i += 1


def quoted(*parts: str) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in parts)
