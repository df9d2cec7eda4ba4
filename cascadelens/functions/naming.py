"""CPE names, repository keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of tests and examples, endings of sources and headers, the form of a CPE name.
TEST_NAMES = ["test", "example", "examples", "demo", "simd", "docs", "doc", "documents", "document"]
SOURCE_ENDINGS = r"\.(cc|c|cpp|cxx|c\+\+|cp|cci)$"
HEADER_ENDINGS = r"\.(h|hpp)$"
LIBRARY_ENDINGS = r"\.(c|cpp|cc|cxx|h|hpp)$"
PRUNED_FOLDERS = ["build", "test", "tests", "doc", "docs"]
CPE = r"^cpe:2\.3:([aho]):([^:]+):([^:]+):([^:]+)"


def cpe_part(uri: Column, index: int) -> Column:
    """Part `index` of a CPE 2.3 name (2 part, 3 vendor, 4 product, 5 version), split at every colon."""
    return F.get(F.split(uri, ":"), F.lit(index))


def parsed_cpe(uri: Column) -> Column:
    """struct(part, vendor, product, version), null parts where the name doesn't match."""
    part = lambda i: F.when(uri.rlike(CPE), F.regexp_extract(uri, CPE, i))
    return F.struct(part(1).alias("part"), part(2).alias("vendor"), part(3).alias("product"), part(4).alias("version"))


def repo_key(author: Column, name: Column) -> Column:
    """author%name; a missing author is written None."""
    return F.concat(F.coalesce(author, F.lit("None")), F.lit("%"), name)


def split_repo_key(key: Column) -> Column:
    """struct(author, name) of a key with exactly one percent sign, nulls otherwise."""
    parts = F.split(key, "%")
    whole = F.size(parts) == 2
    return F.struct(F.when(whole, parts[0]).alias("author"), F.when(whole, parts[1]).alias("name"))


def is_test_path(path: Column) -> Column:
    """Whether any part of the path is a folder of tests or examples."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in TEST_NAMES]))


def is_source(path: Column) -> Column:
    """Ends like a source file, in any letter case."""
    return F.lower(path).rlike(SOURCE_ENDINGS)


def is_header(path: Column) -> Column:
    """Ends like a header file."""
    return path.rlike(HEADER_ENDINGS)


def is_library_file(path: Column, prune: bool = True) -> Column:
    """Sources and headers; of libraries (not of projects) without hidden, build, test and doc folders."""
    kept = path.rlike(LIBRARY_ENDINGS)
    if not prune:
        return kept
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return kept & ~F.exists(folders, lambda s: s.isin(PRUNED_FOLDERS) | s.rlike(r"^\.[^./]"))


def path_segments(path: Column) -> Column:
    """Lower-case folders of the path, and the file's name without its last ending."""
    return F.split(F.regexp_replace(F.lower(path), r"(?<=[^/])\.[^./]*$", ""), "/")
