"""Texts of an Arrow batch as one array of code points, and back."""

from __future__ import annotations

import numpy as np


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, offsets of length len(texts) + 1); None counts as empty."""
    texts = [t or "" for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def strings(cps: np.ndarray, offsets: np.ndarray) -> list[str]:
    whole = cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64: equal inputs give equal outputs, all output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
