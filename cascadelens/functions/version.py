"""Versions, tags and version conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a version stands in a tag.
TAG = r"(?:[a-zA-Z_-]*[vV]?[a-zA-Z_]*[\-_])?(\d{1,4}(?:[._-]\d{1,4}){0,2})(?:[._][a-zA-Z0-9]*[\-_][a-zA-Z0-9]*)?"


def extract_version(tag: Column) -> Column:
    """Up to three numbers joined by dots; a third of four digits is left out; null without a number."""
    found = F.regexp_replace(F.regexp_extract(tag, TAG, 1), "[._-]", ".")
    parts = F.split(found, r"\.")
    short = F.when((F.size(parts) >= 3) & (F.length(parts[2]) >= 4), F.array_join(F.slice(parts, 1, 2), ".")).otherwise(found)
    return F.when(found != "", short)


def two_part(version: Column) -> Column:
    """major.minor, with minor 0 where there is none."""
    parts = F.split(version, r"\.")
    return F.concat(parts[0], F.lit("."), F.coalesce(F.get(parts, F.lit(1)), F.lit("0")))


def major_minor(version: Column) -> Column:
    """major.minor at the beginning, or an empty text."""
    return F.regexp_extract(version, r"^(\d+\.\d+)", 1)


def is_valid(version: Column) -> Column:
    """One to three numbers joined by dots."""
    return version.rlike(r"^\d+(\.\d+){0,2}$")


def dependency(version: Column) -> Column:
    """struct(kind `^`, `~` or null, base, full) of a version condition."""
    caret, tilde = r"^\^(\d+)\.(\d+)(\.\d+)?$", r"^~(\d+\.\d+)(\.\d+)?$"
    full = F.regexp_replace(version, "^.", "")
    kind = F.when(version.rlike(caret), "^").when(version.rlike(tilde), "~")
    base = F.when(kind == "^", F.regexp_extract(version, caret, 1)).when(kind == "~", F.regexp_extract(version, tilde, 1)).otherwise(version)
    rest = F.when(kind == "^", F.regexp_extract(full, r"^(\d+\.\d+(?:\.\d+)?)", 1)).when(kind == "~", F.regexp_extract(full, r"^(\d+\.\d+(?:\.\d+)?)", 1)).otherwise(version)
    return F.struct(kind.alias("kind"), base.alias("base"), rest.alias("full"))


def compare(a: Column, b: Column) -> Column:
    """-1 if a is lower, else 1 (also when equal); three numeric parts, then the longer is higher."""
    nums = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    x, y = nums(a), nums(b)
    return F.when(x < y, -1).otherwise(1)


def sort_key(tag: Column) -> Column:
    """A text that sorts like the version in a tag: numbers by value, the rest by letters."""
    parts = F.regexp_extract_all(tag, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")


def satisfies(version: Column, kind: Column, base: Column, op: Column, wanted: Column) -> Column:
    """Whether a version meets a condition; operators compare as texts."""
    return (
        F.when(kind.isNotNull(), version.startswith(F.concat(base, F.lit("."))) | (version == base))
        .when(op == ">=", version >= wanted)
        .when(op == "<=", version <= wanted)
        .when(op == ">", version > wanted)
        .when(op == "<", version < wanted)
        .otherwise(version == wanted)
    )
