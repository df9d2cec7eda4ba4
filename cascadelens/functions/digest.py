"""Locality-sensitive digests: texts that differ a little have digests that differ in a few places.

Triplets of characters in a sliding window of five bytes are counted in 128 buckets; each bucket's
quartile is two bits of the digest, kept as two planes of bits, so that distances need no Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least size of a text in bytes, greatest distance of similar digests.
LEAST_BYTES, CUT_OFF = 50, 30
_TRIPLETS = [(2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4)]  # salt, and the second and third byte


def _mixing() -> np.ndarray:
    """A permutation of the byte values, made of bijections."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(3):
        x = (x * 167 + 13) % 256
        x ^= x >> 4
        x = (x * 29 + 101) % 256
        x ^= x >> 3
    return x.astype(np.uint8)


_MIX = _mixing()


def digest(text: str | None) -> list[int] | None:
    """[high plane (2 numbers), low plane (2), two quartile ratios, checksum]; None for short texts."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) if isinstance(text, str) else np.zeros(0, dtype=np.uint8)
    if len(data) < LEAST_BYTES:
        return None
    last = data[4:]
    at = lambda k: data[4 - k : len(data) - k]
    counts = np.zeros(256, dtype=np.int64)
    for salt, i, j in _TRIPLETS:
        h = _MIX[_MIX[_MIX[_MIX[salt] ^ last] ^ at(i)] ^ at(j)]
        counts += np.bincount(h, minlength=256)
    used = counts[:128]
    q1, q2, q3 = np.sort(used)[[31, 63, 95]]
    code = (used > q1).astype(np.uint8) + (used > q2) + (used > q3)
    planes = [np.packbits(bits.astype(np.uint8)).view(">i8").tolist() for bits in (code >> 1, code & 1)]
    ratio = lambda q: int(q * 100 // q3) % 16 if q3 else 0
    check = int(np.bitwise_xor.reduce(_MIX[data]))
    return [*planes[0], *planes[1], ratio(q1), ratio(q2), check]


def digests(df: DataFrame, text: str = "content") -> DataFrame:
    """`df` with `digest`, array<bigint>, in place of the text; null for null texts and those under 50 bytes."""

    @F.pandas_udf("array<bigint>")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(digest)

    return df.withColumn("digest", made(text)).drop(text)


def distance(a: Column, b: Column) -> Column:
    """How far two digests are apart, lengths left out; null with a null."""
    total = F.lit(0)
    for i in (0, 1):
        high, low = F.get(a, F.lit(i)), F.get(a, F.lit(i + 2))
        dh, dl = high.bitwiseXOR(F.get(b, F.lit(i))), low.bitwiseXOR(F.get(b, F.lit(i + 2)))
        # codes differ by one, two or three; three counts double
        inner = high.bitwiseXOR(low)
        one = F.bitwise_not(dh).bitwiseAND(dl).bitwiseOR(dh.bitwiseAND(dl).bitwiseAND(inner))
        two, three = dh.bitwiseAND(F.bitwise_not(dl)), dh.bitwiseAND(dl).bitwiseAND(F.bitwise_not(inner))
        total = total + F.bit_count(one) + 2 * F.bit_count(two) + 6 * F.bit_count(three)
    for i in (4, 5):
        apart = F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i)))
        apart = F.least(apart, 16 - apart)
        total = total + F.when(apart <= 1, apart).otherwise((apart - 1) * 12)
    return (total + (F.get(a, F.lit(6)) != F.get(b, F.lit(6))).cast("int")).cast("int")


def is_similar(far: Column, cut_off: int = CUT_OFF) -> Column:
    """Near, but not the same."""
    return (far > 0) & (far <= cut_off)
