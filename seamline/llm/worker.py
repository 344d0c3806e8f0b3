"""What a Python worker keeps between tasks: the tables of one operator at a time.

Workers outlive jobs. An operator that begins in a worker drops what others kept there, so a pipeline needs
the memory of its largest stage, not of all of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_DROP: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def keeps(name: str, drop: Callable[[], None]) -> None:
    """``name`` keeps tables in this process, which ``drop`` empties."""
    _DROP[name] = drop


def begin(name: str) -> None:
    """``name`` begins or goes on; others' tables go."""
    if _LAST == [name]:
        return
    for other, drop in _DROP.items():
        if other != name:
            drop()
    _LAST[:] = [name]
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps or returns freed memory by its own rules
        pass
