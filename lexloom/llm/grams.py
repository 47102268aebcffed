"""Hashed character n-grams of many texts at once, as array operations."""

from __future__ import annotations

import numpy as np

from lexloom.llm.common import held

_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return held("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a NUL after each, and where each text begins (one more for the end)."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.concatenate([[0], np.cumsum(sizes + 1)])


def letters_only(points: np.ndarray) -> np.ndarray:
    """The code points with everything but letters turned into spaces."""
    return np.where(letters()[points], points, np.uint32(32))


def gram_hashes(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n code points that begin at each place, the last n - 1 places left out."""
    size = max(0, len(points) - n + 1)
    h = np.full(size, (n * 0x632BE5AB) & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ points[i : i + size]) * _MULTIPLIERS[i % 4]
            h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)
