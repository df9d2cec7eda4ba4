"""Problem 6: names typed by hand are mapped to the entry of a reference list that they mean.

A prefix-filter set-similarity join: names and entries are sets of pairs of characters, neighbours and
next but one, ordered by global rarity; two sets can only be as similar as wanted if they share one of
their rarest tokens, so only those meet. Length and positional filters thin out the pairs, Jaccard is
then verified exactly and the best entry is kept. An edit distance looks over the best ones only: it
rejects what merely shares many pairs, and tells entries of the same similarity apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascadelens.session import spread, via_table

#: Least Jaccard similarity of the sets of pairs, and most edits of the best entry.
SIMILARITY, EDITS = 0.42, 3
#: Names with a token are dealt to so many tasks, each of which has all entries with it.
SALTS = 4
#: Endings that set entries apart have at most so many characters, behind so many at least.
ENDING, STEM = 6, 3

# What package names carry around the name proper.
_HOSTED = re.compile(r"^(?:[a-z+]+://|git@)[^/:\s]+[/:](?:.*/)?([^/\s]+)/([^/]+?)(?:\.git)?/?$")
_PACKAGE = re.compile(r"^pkg:[^/]+/(?:([^/@]+)/)?(.+)$")
_VERSION = re.compile(r"(?:\s*(?:==|>=|<=|~=|@|=)\s*|\s+v?|[-_]v?)\d+(?:\.\d+)+[a-z0-9.-]*$|\s*\(\s*v?\d+(?:\.\d+)+[^)]*\)$|\s+v\d+$")
_BUNDLED = re.compile(r"\s*\((?:bundled|vendored|embedded|patched|system|static|shared|optional|fork)\)$")
_IN_BRACKETS = re.compile(r"^(.*?)\s*\(([^()]+)\)$")
_BY = re.compile(r"^(.*?)\s+by\s+(\S.*)$")
_SCOPED = re.compile(r"^@?([^/:@\s]+)(?:/|::|:)\s*(.+)$")
_BINARY = re.compile(r"\.(?:a|so|dll|dylib|lib)(?:\.\d+)*$")
_SUFFIX = re.compile(r"(?:[-_. ]+(?:library|lib|libs|dev|devel|static|shared|src|source|sdk|headers)|(?<=[a-z0-9]{3})(?:sdk|lib))$")
_PREFIX = re.compile(r"^lib[-_. ]+(?=\S{3})|^lib(?=[a-z0-9]{3})")
FILLERS = {"", "-", "--", "n/a", "na", "none", "null", "unknown", "tbd", "todo", "?", "unspecified", "other", "misc"}


def fold(text: str) -> str:
    """Lower case without accents, in plain letters, outer white space cut."""
    wide = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).casefold()
    return "".join(c for c in wide if not unicodedata.combining(c)).strip()


def squeeze(text: str) -> str:
    """Letters, digits and plus signs only."""
    return re.sub(r"[^a-z0-9+]", "", text)


def readings(depname: str) -> tuple[str, list[str], str]:
    """(vendor or empty, possible names, least decorated first; empty list for fillers, words)."""
    text = fold(depname)
    if text in FILLERS:
        return "", [], ""
    vendor = ""
    if m := _PACKAGE.match(text):
        vendor, text = m[1] or "", m[2]
    text = _BUNDLED.sub("", text)
    text = _VERSION.sub("", text)
    if m := _HOSTED.match(text):
        vendor, text = m[1], m[2]
    elif m := _IN_BRACKETS.match(text):
        text, vendor = m[1], m[2]
    elif m := _BY.match(text):
        text, vendor = m[1], m[2]
    elif m := _SCOPED.match(text):
        vendor, text = m[1], m[2]
    text = _VERSION.sub("", _BINARY.sub("", text)).strip()
    names = [text]
    for _ in range(3):
        shorter = _SUFFIX.sub("", names[-1]).strip(" -_.")
        if shorter == names[-1] or not shorter:
            break
        names.append(shorter)
    for name in list(names):
        shorter = _PREFIX.sub("", name)
        if shorter != name:
            names.append(shorter)
    return squeeze(vendor), list(dict.fromkeys(n for n in names if squeeze(n))), text


def turned(name: str) -> str:
    """The name with its words in turned order: `archive, indigo` is `indigo archive`."""
    words = [w for w in re.split(r"[\s,_.-]+", name) if w]
    return squeeze("".join(words[::-1])) if 2 <= len(words) <= 3 else ""


def pairs_of(key: str) -> list[str]:
    """Distinct pairs of neighbours, and of characters next but one, of a squeezed name with its ends marked."""
    marked = f"^{key}$"
    return sorted({marked[i] + marked[i + d] for d in (1, 2) for i in range(len(marked) - d)})


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


_KEYS = "depname string, vendor string, key string, form int, turned boolean, tokens array<string>"


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for depname in pdf["depname"]:
            vendor, names, _ = readings(depname)
            for form, name in enumerate(names):
                for key, is_turned in ((squeeze(name), False), (turned(name), True)):
                    if key:
                        out.append((depname, vendor, key, form, is_turned, pairs_of(key)))
        yield pd.DataFrame(out, columns=["depname", "vendor", "key", "form", "turned", "tokens"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for ref, git, cpe in zip(pdf["ref_id"], pdf["git_key"], pdf["cpe_key"], strict=True):
            owner, _, repo = (git or "").partition("@@")
            maker, _, product = re.sub(r"\\(.)", r"\1", cpe or "").partition("@@")
            for key in dict.fromkeys(squeeze(fold(x)) for x in (product, repo)):
                if key:
                    out.append((ref, key, [squeeze(fold(owner)), squeeze(fold(maker))], pairs_of(key)))
        yield pd.DataFrame(out, columns=["ref_id", "key", "vendors", "tokens"])


def _prefixes(sets: DataFrame, rank: DataFrame, key: str) -> DataFrame:
    """key, ending, token (its rank), pos, n, ordered for the prefix of each set, rarest token first."""
    ordered = sets.select(key, "ending", F.explode("tokens").alias("token")).join(rank, "token").groupBy(key, "ending").agg(F.sort_array(F.collect_list("rank")).alias("ordered"))
    n = F.size("ordered")
    length = n - F.ceil(SIMILARITY * n - 1e-9).cast("int") + 1
    return ordered.withColumn("n", n).select(key, "ending", "n", "ordered", F.posexplode(F.slice("ordered", F.lit(1), length)).alias("pos", "token"))


def similar_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(key, ending, tokens), right(...), distinct keys each: left_key, right_key, jaccard >= SIMILARITY, left_ending, right_ending of all pairs."""
    tokens = left.select(F.explode("tokens").alias("token")).unionByName(right.select(F.explode("tokens").alias("token")))
    # at most the pairs of the 40 characters that squeezed names are made of, so one task can rank them
    rank = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).select("token", F.row_number().over(Window.orderBy("seen", "token")).alias("rank"))
    x = _prefixes(left.withColumnRenamed("key", "left_key"), rank, "left_key").select("left_key", F.col("ending").alias("left_ending"), "token", F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("ordered").alias("ox"))
    y = _prefixes(right.withColumnRenamed("key", "right_key"), rank, "right_key").select("right_key", F.col("ending").alias("right_ending"), "token", F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("ordered").alias("oy"))
    need = F.ceil((F.col("nx") + F.col("ny")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    fits: Column = (F.col("ny") >= SIMILARITY * F.col("nx") - 1e-9) & (F.col("nx") >= SIMILARITY * F.col("ny") - 1e-9)
    fits &= F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= need
    # little data, much work: as many tasks as there are partitions, and no token in one task alone
    tasks, keys = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["token", "salt"]
    x = x.withColumn("salt", F.pmod(F.xxhash64("left_key"), F.lit(SALTS)).cast("int")).repartition(tasks, *keys)
    y = y.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).repartition(tasks, *keys)
    met = x.join(y.hint("shuffle_hash"), keys).where(fits).withColumn("both", F.array_intersect("ox", "oy"))
    # only the first prefix token that both have stands for the pair, so no pair is verified twice
    shared = F.size("both")
    jaccard = shared / (F.col("nx") + F.col("ny") - shared)
    return met.where(F.col("both")[0] == F.col("token")).select("left_key", "right_key", jaccard.alias("jaccard"), "left_ending", "right_ending").where(F.col("jaccard") >= SIMILARITY - 1e-9)


def _tails(keys: DataFrame) -> DataFrame:
    """key, head, tail for every ending that could set a key apart."""
    most = F.least(F.lit(ENDING), F.length("key") - STEM)
    cut = keys.where(F.length("key") > STEM).select("key", F.explode(F.sequence(F.lit(1), most)).alias("n"))
    return cut.select("key", F.expr("left(key, length(key) - n)").alias("head"), F.expr("right(key, n)").alias("tail"))


def endings(keys: DataFrame) -> DataFrame:
    """tail: what sets apart two names of the list of which one begins with the other: mined, not given."""
    return _tails(keys).join(keys.select(F.col("key").alias("head")), "head").select("tail").distinct()


def with_ending(sets: DataFrame, marks: DataFrame) -> DataFrame:
    """`sets` with the longest ending of the key that is among the marks, or an empty text."""
    found = _tails(sets.select("key")).join(marks, "tail").groupBy("key").agg(F.max_by("tail", F.length("tail")).alias("ending"))
    return sets.join(found, "key", "left").withColumn("ending", F.coalesce("ending", F.lit("")))


def set_apart(key: str, ending: str, entry: str, entry_ending: str) -> bool:
    """Whether a name differs from an entry in an ending, and not by a slip: `onyx2` doesn't mean `onyx`, but `onyxlit` may mean `onyxlite`.

    A name that has an ending must have the entry's. One without means an entry that has one only if the
    whole explains it as well as what stands before the ending does.
    """
    if ending or not entry_ending:
        return ending != entry_ending
    edits = edit_distance(key, entry, EDITS)
    return edits > EDITS or edit_distance(key, entry.removesuffix(entry_ending), EDITS) < edits


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        apart = [set_apart(*x) for x in zip(pdf["left_key"], pdf["left_ending"], pdf["right_key"], pdf["right_ending"], strict=True)]
        yield pdf.loc[~pd.Series(apart, index=pdf.index, dtype=bool), ["left_key", "right_key", "jaccard"]]


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(edits=[edit_distance(x, y, EDITS) for x, y in zip(pdf["key"], pdf["right_key"], strict=True)])


def canonical(names: DataFrame, entries: DataFrame) -> DataFrame:
    """depname, ref_id, cpe23uri, jaccard, edits, status of every distinct non-null name.

    status is `matched`, `ambiguous` (the best entries are several, and no maker is named that one of
    them has) or `unmatched`; ref_id and what follows are null unless matched. Fillers, empty and
    blank names are unmatched, null ones are left out. Names that differ from an entry in an ending
    that sets entries of the list apart (`2`, `lite`) don't mean that entry (`set_apart`). Lists of any length are taken.
    """
    distinct = names.select("depname").where("depname is not null").distinct()
    spelled = via_table(spread(distinct).mapInPandas(_spell, _KEYS), "spelled")
    listed = via_table(entries.select("ref_id", "git_key", "cpe_key").mapInPandas(_entries, "ref_id bigint, key string, vendors array<string>, tokens array<string>"), "entries")
    known = listed.select("key", "tokens").dropDuplicates(["key"])
    asked = spelled.select("key", "tokens").dropDuplicates(["key"])
    marks = via_table(endings(known.select("key")), "endings")
    # a key that stands in the list has its match; the others look for the most alike
    equal = asked.join(known.select("key"), "key", "left_semi").select(F.col("key").alias("left_key"), F.col("key").alias("right_key"), F.lit(1.0).alias("jaccard"))
    others = asked.join(known.select("key"), "key", "left_anti")
    alike = similar_keys(with_ending(others, marks), with_ending(known, marks)).mapInPandas(_agreeing, "left_key string, right_key string, jaccard double")
    pairs = via_table(equal.unionByName(alike), "pairs")
    met = spelled.select("depname", "vendor", "key", "form", "turned").join(pairs, F.col("key") == F.col("left_key")).drop("left_key")
    most = met.groupBy("depname").agg(F.max("jaccard").alias("most"))
    best = met.join(most, "depname").where(F.col("jaccard") == F.col("most")).drop("most")
    looked = best.select("key", "right_key").distinct().mapInPandas(_edits, "key string, right_key string, edits int").where(F.col("edits") <= EDITS)
    joined = best.join(looked, ["key", "right_key"]).join(listed.select(F.col("key").alias("right_key"), "ref_id", "vendors"), "right_key")
    made = F.array_contains("vendors", F.col("vendor")) & (F.col("vendor") != "")
    # of the most alike those of fewest edits, then the name as it stands before its turned and shortened forms
    order = F.struct("edits", "turned", "form")
    ranked = via_table(joined.withColumn("o", order).withColumn("made", made), "ranked")
    first = ranked.groupBy("depname").agg(F.min("o").alias("first"))
    chosen = (
        ranked.join(first, "depname")
        .where(F.col("o") == F.col("first"))
        .groupBy("depname")
        .agg(
            F.count_distinct("ref_id").alias("n"),
            F.count_distinct(F.when(F.col("made"), F.col("ref_id"))).alias("n_made"),
            F.min("ref_id").alias("any_ref"),
            F.min(F.when(F.col("made"), F.col("ref_id"))).alias("made_ref"),
            F.min("jaccard").alias("j"),
            F.min("edits").alias("edits"),
        )
    )
    ref = F.when(F.col("n_made") == 1, F.col("made_ref")).when(F.col("n") == 1, F.col("any_ref"))
    settled = chosen.select("depname", ref.alias("ref_id"), F.when(ref.isNotNull(), F.col("j")).alias("jaccard"), F.when(ref.isNotNull(), F.col("edits")).alias("edits"), F.lit(True).alias("near"))
    uris = entries.groupBy("ref_id").agg(F.min("cpe23uri").alias("cpe23uri"))
    status = F.when(F.col("ref_id").isNotNull(), "matched").when(F.col("near"), "ambiguous").otherwise("unmatched")
    return distinct.join(settled, "depname", "left").join(uris, "ref_id", "left").select("depname", "ref_id", "cpe23uri", "jaccard", "edits", status.alias("status"))


def map_rows(rows: DataFrame, row_id: str, entries: DataFrame) -> DataFrame:
    """row_id, depname, ref_id, cpe23uri, status of every row; a null depname is unmatched."""
    found = canonical(rows, entries)
    return rows.select(row_id, "depname").join(found, "depname", "left").select(row_id, "depname", "ref_id", "cpe23uri", F.coalesce("status", F.lit("unmatched")).alias("status"))
