"""Domain names in Python, for values that only Python can walk; the same rules as the columns."""

from __future__ import annotations

import re

_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_NAME = re.compile(rf"{_LABEL}(\.{_LABEL})+")


def looks_like(x: str) -> bool:
    x = x.strip().rstrip(".")
    return len(x.encode()) <= 253 and x.lower() != "localhost" and bool(_NAME.fullmatch(x))


def norm(x: str) -> str:
    return x.strip().rstrip(".").lower()
