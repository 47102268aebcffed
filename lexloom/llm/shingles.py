"""Sets of word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes other than space and the control characters from tab to carriage return, A-Z lower-cased.  A
text's set holds each run of SIZE words once; with fewer words, the whole sequence is its one shingle; without words
the set is empty.
"""

from __future__ import annotations

import numpy as np

from lexloom.llm.common import held, in_portions, mix64

SIZE = 5
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)]
#: Portions of texts have up to about so many bytes, so their powers are kept; a longer text's are made for it alone.
_KEPT = 1 << 20


def _powers(n: int):
    """Powers of the hash's base and of its inverse, modulo 2^64, at least n of them."""

    def made(size):
        with np.errstate(over="ignore"):
            return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))

    return held("powers", lambda: made(_KEPT)) if n <= _KEPT else made(n)


def word_hashes(texts: list[bytes], lower: bool = True):
    """(hash of every word, number of the text it is in); lower: with A-Z lower-cased."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = _LOWER[raw] if lower else raw
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        h = (total[end] - total[begin]) * down[begin]
    text = np.searchsorted(np.cumsum(sizes + 1), begin, "right")
    return mix64(h, 7), text


def shingle_sets(texts: list[str | None], portion: int = 1_000_000):
    """(sorted distinct hashes, set sizes) for each portion of consecutive texts: the sets one after the other."""
    for a, b in in_portions([t or "" for t in texts], portion):
        words, of = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]])
        n = np.bincount(of, minlength=b - a)
        first = np.cumsum(n) - n
        if len(words) >= SIZE:
            windows = len(words) - SIZE + 1
            with np.errstate(over="ignore"):
                h = sum(words[i : i + windows] * _ODD[i] for i in range(SIZE))
            inside = of[:windows] == of[SIZE - 1 :]
            hashes, owner = mix64(h[inside], 3), of[:windows][inside]
        else:
            hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        small = np.flatnonzero((n > 0) & (n < SIZE))
        if len(small):
            whole = []
            with np.errstate(over="ignore"):
                for i in small:
                    h = np.uint64(n[i])
                    for w in words[first[i] : first[i] + n[i]]:
                        h = mix64(np.array([h * _ODD[4] + w]), 11)[0]
                    whole.append(h)
            hashes, owner = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([owner, small])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
        many = np.bincount(owner, minlength=b - a)
        upto = np.cumsum(many)
        sets = [np.unique(hashes[e - m : e]) for e, m in zip(upto, many, strict=True)]
        yield np.concatenate([np.zeros(0, np.uint64), *sets]), np.fromiter(map(len, sets), np.int64, b - a)
