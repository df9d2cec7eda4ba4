"""Hashes and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cascadelens.functions import text as T
from cascadelens.session import spread

#: So many tokens are hashed and counted at a time, or one text.
TOKENS = 1 << 18


def md5_low64(value: Column) -> Column:
    """The low 64 bits of the MD5 as a two's complement number."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 17, 16), 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def _token_features(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """row_id, single, bigram of every token; one row a token keeps all of it in generated code."""
    toks = df.select(row_id, T.tokens(T.preprocess(F.col(content))).alias("t"))
    # every token with the next one, so that no row carries the whole array
    pairs = F.arrays_zip(F.col("t").alias("x"), F.slice("t", F.lit(2), F.size("t")).alias("next"))
    each = toks.where(F.size("t") > 0).select(row_id, F.inline(pairs).alias("x", "next"))
    kind = T.feature_class(F.col("x"))
    word = F.when(kind == "keyword", F.lower("x")).otherwise(F.col("x"))
    return each.select(row_id, F.concat(kind, F.lit("_"), word).alias("single"), F.concat(F.lit("bigram_"), "x", F.lit("_"), "next").alias("bigram"))


def features(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """row_id, feature, n: keywords, identifiers, operators and bigrams of the preprocessed text."""
    both = _token_features(df, row_id, content).select(row_id, F.explode(F.array("single", "bigram")).alias("feature"))
    return both.where("feature is not null").groupBy(row_id, "feature").agg(F.count(F.lit(1)).alias("n"))


def _low64s(features: list[bytes]) -> np.ndarray:
    """As `md5_low64`."""
    return np.frombuffer(b"".join(hashlib.md5(f).digest()[8:] for f in features), ">u8").astype(np.uint64)


def _single(token: bytes) -> bytes | None:
    """The feature of a token of `T.tokens` by itself, as in `_token_features`."""
    word = token.decode()
    if word.lower() in T.KEYWORDS:
        return b"keyword_" + word.lower().encode()
    if word.isalpha():
        return b"identifier_" + token
    return None if word.isalnum() else b"operator_" + token


def _bit_counts(lengths: np.ndarray, tokens: pa.Array) -> list[np.ndarray]:
    """For texts of so many tokens each, none of them empty, all one after another: n, c0 to c31 of `simhash`.

    Every token and every two tokens that follow each other are hashed once a batch, however often they occur.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    known = tokens.dictionary_encode()
    words, codes = known.dictionary.to_pylist(), known.indices.to_numpy().astype(np.int64)
    single = [_single(w) for w in words]
    # what is no feature has no bits; the last token of a text has no next one
    h = np.zeros(len(words), np.uint64)
    is_single = np.array([f is not None for f in single])
    h[is_single] = _low64s([f for f in single if f is not None])
    follows = np.ones(len(codes), bool)
    follows[ends - 1] = False
    place = np.flatnonzero(follows)
    pairs = pa.array(codes[place] * len(words) + codes[place + 1]).dictionary_encode()
    x, y = np.divmod(pairs.dictionary.to_numpy(), len(words))
    g = _low64s([b"bigram_%b_%b" % (words[i], words[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
    singles, bigrams = h[codes], np.zeros(len(codes), np.uint64)
    bigrams[place] = g[pairs.indices.to_numpy()]
    # counters beside one another in a word: of 16 bits, if two features a token can't fill them
    width = 16 if lengths.max() < 1 << 15 else 32
    lowest = np.uint64(sum(1 << at for at in range(0, 64, width)))
    bit = [np.zeros(0, np.uint64)] * 64
    for i in range(width):
        sums = np.add.reduceat(((singles >> np.uint64(i)) & lowest) + ((bigrams >> np.uint64(i)) & lowest), starts)
        for at in range(0, 64, width):
            bit[i + at] = (sums >> np.uint64(at)) & np.uint64((1 << width) - 1)
    n = np.add.reduceat(is_single[codes].astype(np.int64), starts) + lengths - 1
    return [n, *[(bit[i] | bit[i + 32] << np.uint64(32)).view(np.int64) for i in range(32)]]


def simhash(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """row_id, fingerprint of every row with a content.

    A bit is set if the features with that bit outweigh those without; ties and texts without features
    give 0. Two bit counters share one long (32 bits each), so 64 bits take 32 sums and not 64. All
    features of a row are added up before the shuffle. They are hashed in Arrow batches, where what occurs
    again is looked up; an expression would make a row of every token and hash it wherever it stands.
    """
    texts = spread(df.select(row_id, content)).select(row_id, T.tokens(T.preprocess(F.col(content))).alias("t"))
    counts = ["n", *[f"c{i}" for i in range(32)]]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # left out here, as a filter would be moved below the tokens and find them a second time
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            lengths = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            first, ends = 0, np.cumsum(lengths)
            while first < len(lengths):  # long texts by fewer at a time
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - lengths[first] + TOKENS, "right")))
                part = batch.slice(first, last - first)
                made = _bit_counts(lengths[first:last], part.column(1).flatten().cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, made)], [row_id, *counts])
                first = last

    counted = texts.mapInArrow(count, StructType([texts.schema[row_id], *[StructField(c, LongType()) for c in counts]]))
    packed = counted.groupBy(row_id).agg(*[F.sum(c).alias(c) for c in counts])
    low = lambda i: F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda i: F.shiftrightunsigned(f"c{i}", 32)
    value = F.lit(0).cast("bigint")
    for i in range(32):
        value = value.bitwiseOR(F.when(2 * low(i) > F.col("n"), F.lit(1 << i).cast("bigint")).otherwise(0))
        value = value.bitwiseOR(F.when(2 * high(i) > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), i + 32)).otherwise(0))
    made = packed.select(row_id, value.alias("fingerprint"))
    return df.where(F.col(content).isNotNull()).select(row_id).join(made, row_id, "left").select(row_id, F.coalesce("fingerprint", F.lit(0)).alias("fingerprint"))
