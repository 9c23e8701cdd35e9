"""What a Python worker holds from one task to the next: workers outlive stages, so what one operator built would stay beside what the next one needs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def only(key: Any, make: Callable[[], Any]) -> Any:
    """The thing of that key, made when a worker first asks for it; what other keys held goes."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what earlier tasks held, and of memory that Arrow keeps back."""
    _held.clear()
    pa.default_memory_pool().release_unused()
