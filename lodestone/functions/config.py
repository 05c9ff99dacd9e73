"""Settings from environment variables: the default where a variable is unset or can't be read."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import timedelta
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")


def _read(key: str, default: T, parse: Callable[[str], T]) -> T:
    try:
        return parse(os.environ[key])
    except (KeyError, ValueError):
        return default


def whole(key: str, default: int, low: int = -(2**31), high: int = 2**64 - 1) -> int:
    """An integer from low to high: unsigned with low 0."""

    def parse(text: str) -> int:
        value = int(text) if text.strip() == text and "_" not in text else int("")
        if not low <= value <= high:
            raise ValueError(key)
        return value

    return _read(key, default, parse)


def flag(key: str, default: bool) -> bool:
    """true, 1, yes and on are true, anything else that is set is false."""
    return _read(key, default, lambda text: text.lower() in ("true", "1", "yes", "on"))


def text(key: str, default: str | None = None) -> str | None:
    return os.environ.get(key, default)


def path(key: str, default: str) -> Path:
    return Path(os.environ.get(key, default))


def seconds(key: str, default: int) -> timedelta:
    return timedelta(seconds=whole(key, default, 0))


def milliseconds(key: str, default: int) -> timedelta:
    return timedelta(milliseconds=whole(key, default, 0))
