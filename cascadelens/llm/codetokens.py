"""Tokens and token runs of C-like source, hashed in numpy for a whole batch of texts at once."""

from __future__ import annotations

import re

import numpy as np

_NOISE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(r"\w")


def _without_noise(match: re.Match) -> str:
    head = match.group()[0]
    return " " if head == "/" else head + head


def bare(text: str) -> str:
    """`text` without comments and without what stands inside quotes; an open quote stays as it is."""
    return _NOISE.sub(_without_noise, text)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _kinds(codes: np.ndarray) -> np.ndarray:
    """0 for blanks, 1 for word characters, 2 for the rest."""
    table = np.full(128, 2, dtype=np.uint8)
    for i in range(128):
        table[i] = 0 if chr(i).isspace() else 1 if _WORD.match(chr(i)) else 2
    if codes.dtype == np.uint8:
        return table[codes]
    kinds = table[np.minimum(codes, 127)]
    beyond = codes > 127
    values, at = np.unique(codes[beyond], return_inverse=True)
    named = [0 if chr(int(v)).isspace() else 1 if _WORD.match(chr(int(v))) else 2 for v in values]
    kinds[beyond] = np.array(named, dtype=np.uint8)[at]
    return kinds


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every token, index of its text); tokens are words and single other characters."""
    joined = "\n".join(texts) + "\n"
    if joined.isascii():
        codes, sizes = np.frombuffer(joined.encode("ascii"), dtype=np.uint8), None
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends_of_text = np.cumsum(sizes)
    kinds = _kinds(codes)
    word = kinds == 1
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero((kinds == 2) | (word & ~before))
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero((kinds == 2) | (word & ~after)) + 1
    up, down = _POWERS.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(ends_of_text, starts, side="right")


def runs(hashes: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `width` consecutive tokens of one text, index of the text)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=owners.dtype)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        value = mix(value + hashes[k : k + n] + np.uint64(k + 1))
    whole = owners[:n] == owners[width - 1 :]
    return value[whole], owners[:n][whole]
