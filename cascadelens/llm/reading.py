"""Problem 10: how demanding the prose of each document is to read.

Code, links, quotations and headings are taken out first; what is left gives features of sentence
length, word length, word rarity in the corpus, connectives, clause depth and lexical diversity. A
regularised ordinal regression, fitted to the raters' bands, turns them into an estimate. Every text is
read once: the buckets of its words are kept, and their rarity is looked up when all are counted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadelens.session import spread, via_table

BANDS = ["easy", "middle", "hard"]
#: At most so many judgements are used to fit; the model has a dozen parameters.
FIT_ROWS = 20_000
#: Words are counted in so many buckets over all documents; the counts are the one thing broadcast.
BUCKETS = 1 << 18
PENALTY = 1e-2

# Words that join clauses, and frequent words that tell languages apart.
CONNECTIVES = set(
    "although though because since whereas while unless until provided whether if when whenever where wherever which whose whom "
    "that as than once lest inasmuch insofar given however nevertheless nonetheless therefore thus hence consequently moreover "
    "furthermore accordingly notwithstanding despite even only so before after".split()
)
FUNCTION_WORDS = {
    "en": set("the a an and or of to in is are was were be been it its that this these those not no with for on by from as at which any every has have had can may must does do if so than then there we you they he she my our your who whose what when where only same one".split()),
    "de": set("der die das und nicht ist ein eine einer eines dem den des mit von zu auf im in es sich wird werden wurde auch bei nach nur als aus für wenn dass oder bitte noch".split()),
    "es": set("el la los las un una y de del que en es no se con por para al lo su sus como más este esta si cuando o ha han fue puede versión".split()),
    "fr": set("le la les un une et de des du que en est ne pas se avec par pour au aux son ses comme plus ce cette si ou dans sur".split()),
}

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)|(?:https?|ftp|git)://\S+|www\.\S+|\S+@\S+\.\w+")
_HEADING = re.compile(r"#{1,6}\s")
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]{20,}\"|“[^”]{20,}”|«[^»]{20,}»")
_TRAILER = re.compile(r"^(?:[A-Z][\w-]*(?:-by)?: \S.{0,80}|[\w./-]+: [a-z0-9 _./-]{0,60}|CVE-\d+-\d+\S*|\[CVE-[^\]]*\].*|#\d+ +0x.*|.*\bwrote:|-- ?|[=\-~^*_#]{3,}|Advisory for .*)$")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:#include|#define|return\b|at \S+\(|File \"|\$ |>>> )|^\s*[\w.*&\[\]>-]+\s*(?:[-+*/|&^]?=|\+\+|--)\s*\S*.*;?$|^\w+\(.*\)\s*$")
_COMMENT_EDGE = re.compile(r"^\s*(?:/\*+|\*+/)\s*$")
_COMMENT_MARK = re.compile(r"^\s*(?://+|\*|/\*+)\s?(?=\S)")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-ZÄÖÜ0-9])")


def own_prose(text: str) -> list[str]:
    """The sentences of `text` that are its own prose."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    # a pattern is tried only where a character is that it can't do without
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    blocks: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        if open_block:
            blocks.append(" ".join(open_block))
            open_block.clear()

    lines = text.split("\n")
    in_comment = False
    for i, line in enumerate(lines):
        under = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if "/" in line and _COMMENT_EDGE.match(line):
            in_comment = "/*" in line
            close()
            continue
        bare = line.strip()
        if not bare or bare.startswith((">", "|")) or _TRAILER.match(bare):
            close()
            continue
        if (bare[0] == "#" and _HEADING.match(bare)) or (len(under) >= 3 and not under.strip("=-~") and len(bare) < 90):
            close()
            continue
        indented = line.startswith(("    ", "\t"))
        body = _COMMENT_MARK.sub("", line) if not indented and bare[0] in "/*" else line
        if indented or (_CODE_LINE.search(body) and not re.search(r"[.!?]\s*$", body)):
            close()
            continue
        if _BULLET.match(line) and not in_comment:
            close()
            body = _BULLET.sub("", line)
        open_block.append(body.strip())
    close()
    sentences = []
    for block in blocks:
        if "://" in block or "](" in block or "@" in block or "www." in block:
            block = _LINK.sub(r"\1", block)
        if "`" in block:
            block = _INLINE.sub(" ", block)
        if '"' in block or "“" in block or "«" in block:
            block = _QUOTED.sub(" ", block)
        sentences.extend(s for s in _SENTENCE.split(block) if s.strip())
    return sentences


def _words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


_SPEAKS = {w: frozenset(k for k, v in FUNCTION_WORDS.items() if w in v) for v in FUNCTION_WORDS.values() for w in v}
_BEYOND_LATIN = re.compile("[^\\W\\d_\u0000-\u024f]")
_LETTER = re.compile(r"[^\W\d_]")


def letters_of(text: str) -> tuple[int, int]:
    """How many letters a text has, and how many of them are Latin."""
    if text.isascii():
        return 1, 1
    letters = len(text) - len(_LETTER.sub("", text))
    return letters, letters - len(_BEYOND_LATIN.findall(text))


def is_english(words: list[str], letters: int, latin: int) -> bool:
    """Whether prose of these words is English: by its function words, and by its letters."""
    if not words or latin < 0.6 * letters:
        return False
    share = Counter()
    for speaks, n in Counter(map(_SPEAKS.get, words)).items():
        for k in speaks or ():
            share[k] += n
    return share["en"] >= 0.12 * len(words) and share["en"] > max(share[k] for k in FUNCTION_WORDS if k != "en")


FEATURES = ["sentence_log", "sentence_long", "word_length", "word_long", "word_very_long", "rarity", "connectives", "clauses", "depth", "diversity", "length_log"]


class _Buckets(dict):
    """The count bucket of each word, the same on every machine; forgets all at a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = n = zlib.crc32(word.encode()) % BUCKETS
        return n


_BUCKETS = _Buckets()


def buckets_of(words: list[str]) -> np.ndarray:
    """The count bucket of each word."""
    return np.fromiter(map(_BUCKETS.__getitem__, words), dtype=np.int32, count=len(words))


def features(sentences: list[list[str]], marks: list[int], rarity: float = 0.0) -> np.ndarray:
    """Features of a document's prose; those of sentences are averaged over words. `rarity` is the mean of its words."""
    sizes = list(map(len, sentences))
    flat = [w for s in sentences for w in s]
    n = len(flat)
    lengths = list(map(len, flat))
    joins = [sum(map(CONNECTIVES.__contains__, s)) for s in sentences]
    weighed = lambda values: sum(k * v for k, v in zip(sizes, values, strict=True)) / n
    return np.array(
        [
            weighed([math.log1p(k) for k in sizes]),
            weighed([k > 25 for k in sizes]),
            sum(lengths) / n,
            sum(map((8).__le__, lengths)) / n,
            sum(map((12).__le__, lengths)) / n,
            rarity,
            sum(joins) / n,
            weighed([min(k, 8) for k in joins]),
            weighed([min(k, 8) for k in marks]),
            len(set(flat)) / math.sqrt(n),
            math.log1p(n),
        ]
    )


def _prepared(text: object) -> tuple[list[list[str]], list[int], bool]:
    if not isinstance(text, str) or not text.strip():
        return [], [], False
    sentences = own_prose(text)
    words = [_words(s) for s in sentences]
    kept = [(w, s.count(",") + s.count(";") + s.count(":")) for w, s in zip(words, sentences, strict=True) if w]
    flat = [x for w, _ in kept for x in w]
    return [w for w, _ in kept], [m for _, m in kept], is_english(flat, *letters_of("".join(sentences)))


def read_documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, english, n_words, x (features but for rarity), buckets (of the words, in order); null where there is no English prose."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, t in zip(pdf[doc_id], pdf[text], strict=True):
                sentences, marks, english = _prepared(t)
                x = features(sentences, marks) if english else None
                words = buckets_of([w for s in sentences for w in s]) if english else None
                out.append((key, english, sum(map(len, sentences)), x, words))
            yield pd.DataFrame(out, columns=[doc_id, "english", "n_words", "x", "buckets"])

    return df.select(doc_id, text).mapInPandas(read, f"{doc_id} bigint, english boolean, n_words bigint, x array<double>, buckets array<int>")


def word_rarity(read: DataFrame) -> np.ndarray:
    """Minus the logarithm of the share of each bucket's words in the prose of all documents."""
    rows = read.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(BUCKETS)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return -np.log((counts + 1.0) / (counts.sum() + BUCKETS))


def with_rarity(read: DataFrame, rarity: np.ndarray) -> DataFrame:
    """doc_id, english, n_words and the whole of x."""
    held = read.sparkSession.sparkContext.broadcast(rarity.astype(np.float32))
    place = FEATURES.index("rarity")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs = []
            for x, words in zip(pdf["x"], pdf["buckets"], strict=True):
                if x is not None:
                    x = np.array(x)
                    x[place] = held.value[words].mean()
                xs.append(x)
            yield pdf[["doc_id", "english", "n_words"]].assign(x=xs)

    return read.mapInPandas(add, "doc_id bigint, english boolean, n_words bigint, x array<double>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit_ordinal(x: np.ndarray, y: np.ndarray, classes: int = 3, rounds: int = 1500) -> dict[str, np.ndarray]:
    """Proportional-odds regression with a ridge penalty, by accelerated gradient steps.

    P(y <= k) = sigmoid(cut_k - x.w); the cuts are kept in order by their differences' logarithms.
    """
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    n, p = z.shape
    share = np.clip(np.array([(y <= k).mean() for k in range(classes - 1)]), 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    theta = np.r_[np.zeros(p), cuts[0], np.log(np.maximum(np.diff(cuts), 0.1))]

    def unpack(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return t[:p], np.cumsum(np.r_[t[p], np.exp(t[p + 1 :])])

    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, c = unpack(theta)
        s = z @ w
        edges = np.c_[np.zeros(n), _sigmoid(c[None, :] - s[:, None]), np.ones(n)]
        slope = edges * (1 - edges)
        upper, lower = edges[np.arange(n), y + 1], edges[np.arange(n), y]
        up, low = slope[np.arange(n), y + 1], slope[np.arange(n), y]
        chance = np.maximum(upper - lower, 1e-9)
        gs = (up - low) / chance  # d(-log chance)/ds
        gc = np.array([(np.where(y == k, -up / chance, 0) + np.where(y == k + 1, low / chance, 0)).mean() for k in range(classes - 1)])
        tail = np.cumsum(gc[::-1])[::-1]
        grad = np.r_[(z * gs[:, None]).mean(0) + PENALTY * w, tail[0], tail[1:] * np.exp(theta[p + 1 :])]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - 0.05 / (1 + step / 500) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w, c = unpack(theta)
    return {"w": w / scale, "cuts": c + (mean / scale) @ w}


def chances(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """n x classes matrix of the bands' probabilities."""
    s = x @ model["w"]
    edges = np.c_[np.zeros(len(s)), _sigmoid(model["cuts"][None, :] - s[:, None]), np.ones(len(s))]
    return np.diff(edges, axis=1)


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, english, n_words, level (0 easy .. 2 hard, as a mean), band; one row a document.

    Null, empty and blank texts, texts of other languages, and texts without prose of their own have
    null level and band. Without any labelled English document all levels are null. Judgements with
    an unknown band or a null document are left out; disagreeing ones all count.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = via_table(read_documents(spread(docs), "doc_id", "text"), "words")
    read = via_table(with_rarity(words, word_rarity(words)), "reading")
    judged = labels.where(F.col("band").isin(*BANDS)).select("doc_id", "rater", "band")
    # a bounded sample, the same at every run: the judgements with the least hashes
    taken = judged.orderBy(F.xxhash64("doc_id", "rater", "band"), "doc_id", "rater", "band").limit(FIT_ROWS)
    sample = taken.join(read.where("x is not null"), "doc_id").select("x", "band", "doc_id", "rater").toPandas().sort_values(["doc_id", "rater", "band"])
    if not len(sample):
        return read.select("doc_id", "english", "n_words", F.lit(None).cast("double").alias("level"), F.lit(None).cast("string").alias("band"))
    model = spark.sparkContext.broadcast(fit_ordinal(np.stack(sample["x"].to_list()), sample["band"].map(BANDS.index).to_numpy()))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", "english", "n_words"]].copy()
            out["level"], out["band"] = np.nan, None
            has = pdf["x"].notna().to_numpy()
            if has.any():
                p = chances(np.stack(pdf.loc[has, "x"].to_list()), model.value)
                out.loc[has, "level"] = p @ np.arange(len(BANDS))
                # the band that holds the median of the estimate
                out.loc[has, "band"] = [BANDS[k] for k in (p.cumsum(1) < 0.5).sum(1)]
            yield out

    rated = read.mapInPandas(rate, "doc_id bigint, english boolean, n_words bigint, level double, band string")
    return rated.withColumn("level", F.when(~F.isnan("level"), F.col("level")))
