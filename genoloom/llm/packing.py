"""Arrays as bytes for the exchange."""

from __future__ import annotations

import numpy as np


def planes(v: np.ndarray) -> bytes:
    """The bytes of an array by significance, so that compression sees the zeros."""
    v = np.ascontiguousarray(v)
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() if len(v) else b""


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()
