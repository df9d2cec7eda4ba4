"""Problem 7: files that were not written by hand: generated, minified, data, or vendored.

Attribute files in the repositories decide first, by the precedence of globs per directory. For
repositories that declare nothing, path patterns are mined from the files that tell by their content
what they are: a directory, a double extension, a name's beginning or end that stands mostly on such
files, in several repositories, marks the others that have it. Directories named after another
project, or after a project with its version, hold copies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascadelens.session import spread, via_table

#: A mined pattern has so many files with it, in so many repositories, of which so great a share tell
#: the kind by their content; copies tell by a notice, which few of them bear.
SUPPORT, SPREAD, SHARE, COPY_SHARE, COPY_LIFT = 5, 3, 0.5, 0.08, 4.0
#: Directory names of more than so many repositories, and more than this share of all, name no project.
COMMON_REPOS, COMMON_SHARE = 10, 0.05
#: At least so many numbers make data, at least so many characters a line make a minified text.
NUMBERS, LINE = 30, 180

# Conventional places of copies, conventional names of generated files, and what
# generators write.
COPY_DIRS = "vendor vendored vendors third_party third-party thirdparty 3rdparty 3rd_party extern external externals deps _deps bundled subprojects contrib node_modules libs".split()
GENERATED_NAME = re.compile(r"(?:^|/)(?:gen|generated|autogen|auto_generated)/|(?:^|/)(?:moc_|qrc_|ui_|lex\.)[^/]*$|\.(?:pb|tab|yy|gen|generated|grpc)\.\w+$|_(?:generated|pb2)\.\w+$", re.I)
MINIFIED_NAME = re.compile(r"\.min\.\w+$|[-_]min\.js$", re.I)
_HEADER = re.compile(
    r"(?i)auto[- ]?matically[\s-]+(?:generated|produced|created|written|made)|\bauto-?generated\b|@generated|\bcode generated by|\b(?:generated|produced|created) (?:automatically )?by\s+\S+.*?(?:\bfrom\b|do not|changes)|"
    r"\bgenerated from\b|\bproduced automatically\b|machine[- ]?(?:made|generated|written)|wurde von \S+ (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|generado (?:automáticamente )?por|changes will be lost|do not (?:edit|modify)(?: this file)?(?: by hand| manually)|\bedit \S+ instead"
)
_STYLE = re.compile(r"\byych\b|\byyvsp\b|\b_has_bits_\b|->WriteTag\(|^#line \d+ \"", re.M)
_PART_OF = re.compile(r"(?i)this file is part of (?:the )?([\w.+-]+?)(?:\s+v?\d[\w.]*|\s*[.,*\n]|\s+(?:project|library|package))")
_LEAD = re.compile(r"\s*(/\*.*?\*/|(?://[^\n]*\n?)+)", re.S)
_ATTRIBUTES = re.compile(r"(?:^|[/\\])\.gitattributes$")
_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE]-?\d+)?)[uUlLfF]*(?=\s*[,}])")

_SIGNS = "author string, repo_name string, file_path string, size bigint, is_generated int, is_styled int, data_size bigint, min_size bigint, part_of string, code_key bigint, attributes string, birth timestamp"


def _leading_comments(text: str) -> str:
    m = _LEAD.match(text)
    return m.group(1) if m else ""


def row_signs(text: str) -> tuple[int, int, int, int, int, str | None]:
    """(size, says it is generated, looks generated, size if data, size if minified, part of)."""
    lead = _leading_comments(text)
    body = text
    if "/*" in text or "//" in text:
        body = _COMMENT.sub("", text)
    size = len(body)
    data = 0
    if body.count(",") >= NUMBERS - 1:
        numbers = _NUMBER.findall(body)
        if len(numbers) >= NUMBERS and sum(map(len, numbers)) + 2 * len(numbers) > 0.5 * len("".join(body.split())):
            data = size
    lines = sum(1 for line in body.split("\n") if line.strip())
    minified = size if not data and lines and size / lines >= LINE else 0
    part = _PART_OF.search(lead) if lead else None
    return size, int(bool(lead and _HEADER.search(lead))), int(bool(_STYLE.search(body))), data, minified, part[1].lower() if part else None


def _read_signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["file_path"], pdf["content"], strict=True):
            text = text if isinstance(text, str) else ""
            signs = row_signs(text)
            bare = "".join(_COMMENT.sub("", text).split()).encode("utf-8", "surrogatepass")
            key = int.from_bytes(hashlib.blake2b(bare, digest_size=8).digest(), "big", signed=True)
            rows.append((*signs, key, text if isinstance(path, str) and _ATTRIBUTES.search(path) else None))
        signs = pd.DataFrame(rows, columns=["size", "is_generated", "is_styled", "data_size", "min_size", "part_of", "code_key", "attributes"])
        yield pd.concat([pdf[["author", "repo_name", "file_path"]].reset_index(drop=True), signs, pdf["birth_time"].rename("birth").reset_index(drop=True)], axis=1)


def normal_path(path: Column) -> Column:
    """The path with forward slashes, without `./` and doubled slashes."""
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(slashed, r"^(?:\./)+", "")


def _stem(segment: Column) -> Column:
    return F.regexp_replace(F.lower(segment), r"(?:-src|[-_]v?\d+(?:\.\d+)+)$", "")


def attribute_rules(files: DataFrame) -> DataFrame:
    """author, repo_name, rules: the lines of the attribute files `files`(author, repo_name, file_path, content).

    rules is an array of (folder, line number, pattern, attribute, value) of attributes that end in
    `generated` or `vendored`; it is bounded by the attribute files of one repository.
    """
    path = normal_path(F.col("file_path"))
    lines = (
        files.where(path.rlike(r"(?:^|/)\.gitattributes$"))
        .select("author", "repo_name", F.regexp_replace(path, r"/?\.gitattributes$", "").alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
        .where(~F.col("text").rlike(r"^\s*(?:#|$)"))
        .select("author", "repo_name", "folder", "line", F.split(F.trim("text"), r"\s+").alias("words"))
        .select("author", "repo_name", "folder", "line", F.col("words")[0].alias("pattern"), F.explode(F.slice("words", F.lit(2), F.size("words"))).alias("word"))
    )
    attribute = F.regexp_extract("word", r"^[-!]?(?:[\w]+-)?(generated|vendored)(?:=.*)?$", 1)
    value = ~(F.col("word").startswith("-") | F.col("word").startswith("!") | F.lower("word").rlike("=(?:false|0|no)$"))
    named = lines.withColumn("attribute", attribute).withColumn("value", value).where("attribute <> ''")
    rule = F.struct(F.length("folder").alias("depth"), "line", "folder", "pattern", "attribute", "value")
    return named.groupBy("author", "repo_name").agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def glob_to_regex(pattern: str) -> str:
    """A pattern of an attribute file as a regular expression over the path below its folder."""
    anchored = "/" in pattern.rstrip("/")
    pattern = pattern.strip("/") if not pattern.endswith("/") else pattern.strip("/") + "/**"
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out


def declared(path: str, rules: list) -> dict[str, bool]:
    """What the rules say about a path; deeper folders and later lines win."""
    said: dict[str, bool] = {}
    for r in rules:
        folder = r["folder"]
        if folder and not path.startswith(folder + "/"):
            continue
        below = path[len(folder) + 1 :] if folder else path
        if re.fullmatch(glob_to_regex(r["pattern"]), below):
            said[r["attribute"]] = bool(r["value"])
    return said


def _features(path: Column) -> Column:
    """array<string> of what a mined pattern can be: d:folder, x:.extension before the last, s:_end, p:begin_."""
    segments = F.split(F.lower(path), "/")
    folders = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: F.concat(F.lit("d:"), s))
    base = F.element_at(segments, -1)
    double = F.regexp_extract(base, r"^[^.]+(\.\w+)\.\w+$", 1)
    stem = F.regexp_extract(base, r"^([^.]+)", 1)
    end, begin = F.regexp_extract(stem, r"(_[a-z0-9]+)$", 1), F.regexp_extract(stem, r"^([a-z0-9]+_)", 1)
    named = F.filter(F.array(F.struct(F.lit("x:").alias("k"), double.alias("v")), F.struct(F.lit("s:").alias("k"), end.alias("v")), F.struct(F.lit("p:").alias("k"), begin.alias("v"))), lambda x: x["v"] != "")
    return F.array_distinct(F.concat(folders, F.transform(named, lambda x: F.concat(x["k"], x["v"]))))


def classify(functions: DataFrame) -> DataFrame:
    """author, repo_name, file_path (as stored), kind, reason of every file, once.

    kind is `generated`, `minified`, `data` or `vendored`; null for hand-written files. Null contents
    count as empty; a file with a null path has no patterns and is judged by its content; rows
    delivered twice change nothing. A borrowed function makes no copy of a file.
    """
    wanted = functions.select("author", "repo_name", "file_path", "content", "birth_time")
    # a set of functions is told by its number and by the sum of its 64-bit hashes
    rows = spread(wanted).mapInPandas(_read_signs, _SIGNS).withColumn("code_key", F.col("code_key").cast("decimal(20,0)"))
    files = via_table(
        rows.groupBy("author", "repo_name", "file_path").agg(
            F.sum("size").alias("size"),
            F.max("is_generated").alias("is_generated"),
            F.max("is_styled").alias("is_styled"),
            F.sum("data_size").alias("data_size"),
            F.sum("min_size").alias("min_size"),
            F.min("part_of").alias("part_of"),
            F.count_distinct("code_key").alias("n_functions"),
            F.sum_distinct("code_key").alias("code_sum"),
            F.collect_set("attributes").alias("attributes"),
            F.min("birth").alias("birth"),
        ),
        "files",
    )
    path = normal_path(F.col("file_path"))
    own = F.lower(F.coalesce("repo_name", F.lit("")))
    files = files.withColumn("path", F.coalesce(path, F.lit(""))).withColumn("own", own)
    content = (
        F.when((F.col("size") > 0) & (F.col("data_size") > 0.5 * F.col("size")), "data")
        .when((F.col("size") > 0) & (F.col("min_size") > 0.5 * F.col("size")), "minified")
        .when((F.col("is_generated") == 1) | (F.col("is_styled") == 1), "generated")
    )
    copied = F.col("part_of").isNotNull() & (F.col("part_of") != F.col("own"))
    files = files.withColumn("content_kind", content).withColumn("copied", copied).withColumn("features", _features(F.col("path")))
    repo = F.struct("author", "repo_name")

    # what paths share with files that tell their kind
    base = files.agg(F.avg(F.col("copied").cast("double")).alias("copy_base"))
    kind_count = [F.count(F.when(F.col("content_kind") == k, 1)).alias(k) for k in ("generated", "minified", "data")]
    not_own = F.col("feature") != F.concat(F.lit("d:"), "own")
    mined = files.select(repo.alias("repo"), "own", "content_kind", "copied", F.explode("features").alias("feature")).where(not_own).groupBy("feature", "repo").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("copied"), 1)).alias("c"), *kind_count)
    mined = mined.groupBy("feature").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"), F.sum("c").alias("c"), *[F.sum(k).alias(k) for k in ("generated", "minified", "data")])
    mined = mined.where((F.col("n") >= SUPPORT) & (F.col("repos") >= SPREAD)).crossJoin(F.broadcast(base))
    told = F.col("generated") + F.col("minified") + F.col("data")
    most = F.greatest("generated", "minified", "data")
    kind = F.when(F.col("generated") == most, "generated").when(F.col("minified") == most, "minified").otherwise("data")
    by_content = told >= SHARE * F.col("n")
    by_copies = F.col("feature").startswith("d:") & (F.col("c") >= COPY_SHARE * F.col("n")) & (F.col("c") >= COPY_LIFT * F.col("copy_base") * F.col("n"))
    patterns = mined.where(by_content | by_copies).select("feature", F.when(by_content, kind).otherwise("vendored").alias("mined_kind"))
    keys = ["author", "repo_name", "file_path"]
    exploded = files.select(*keys, "own", "path", F.explode("features").alias("feature")).where(not_own)
    hits = exploded.join(patterns, "feature").groupBy(*keys).agg(F.min(F.struct("mined_kind", "feature")).alias("mined"))

    # folders that are named after another project
    parts = files.select(*keys, "own", repo.alias("repo"), F.split("path", "/").alias("s")).select(*keys, "own", "repo", F.explode(F.slice("s", F.lit(1), F.size("s") - 1)).alias("folder")).withColumn("stem", _stem(F.col("folder")))
    parts = parts.where((F.col("stem") != F.col("own")) & (F.col("stem") != ""))
    repos = files.select("author", "repo_name").distinct()
    n_repos = repos.agg(F.count(F.lit(1)).alias("n_repos"))
    names = repos.where("repo_name is not null").select(F.lower("repo_name").alias("stem")).distinct()
    use = parts.select("repo", "stem").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("used")).crossJoin(F.broadcast(n_repos))
    projects = names.join(use, "stem").where(~((F.col("used") > COMMON_REPOS) & (F.col("used") > COMMON_SHARE * F.col("n_repos")))).select("stem", F.lit(True).alias("project"))
    foreign = parts.join(projects, "stem", "left")
    versioned = F.lower("folder").rlike(r"^[a-z][\w+-]*?[-_]v?\d+(?:\.\d+)+$")
    copies = foreign.where(F.col("project") | versioned | F.lower("folder").isin(COPY_DIRS)).groupBy(*keys).agg(F.min(F.when(F.col("project") | versioned, F.concat(F.lit("folder "), "folder")).otherwise(F.concat(F.lit("place "), "folder"))).alias("place"))

    # whole files under the same name in two projects: the later one is the copy
    base_name = F.element_at(F.split("path", "/"), -1)
    placed = lambda x: x.select(*[F.col(k).alias(f"_{k}") for k in keys])
    at = placed(copies)
    alone = files["author"].eqNullSafe(at["_author"]) & files["repo_name"].eqNullSafe(at["_repo_name"]) & files["file_path"].eqNullSafe(at["_file_path"])
    whole = files.where("n_functions >= 2 and not copied").join(at, alone, "left_anti").select(*keys, "birth", repo.alias("repo"), "n_functions", "code_sum", base_name.alias("base"))
    first = whole.groupBy("base", "n_functions", "code_sum").agg(F.min(F.struct(F.col("birth").isNull().alias("u"), "birth", "repo")).alias("first"), F.count_distinct("repo").alias("k")).where("k > 1 and first.birth is not null")
    twins = whole.join(first, ["base", "n_functions", "code_sum"]).where((F.col("repo") != F.col("first.repo")) & (F.col("birth") > F.col("first.birth"))).select(*keys, F.lit("whole copy").alias("twin"))

    same = lambda a, b: a["author"].eqNullSafe(b["author"]) & a["repo_name"].eqNullSafe(b["repo_name"]) & a["file_path"].eqNullSafe(b["file_path"])

    def add(to: DataFrame, part: DataFrame, column: str) -> DataFrame:
        return to.join(part, same(to, part), "left").select(*[to[c] for c in to.columns], part[column])

    out = files.select(*keys, "path", "content_kind", "copied")
    out = add(add(add(out, hits, "mined"), copies, "place"), twins, "twin")
    rules = attribute_rules(files.select("author", "repo_name", "file_path", F.explode("attributes").alias("content")))
    out = out.join(rules, out["author"].eqNullSafe(rules["author"]) & out["repo_name"].eqNullSafe(rules["repo_name"]), "left").select(*[out[c] for c in out.columns], rules["rules"])
    named = F.when(F.lower("path").rlike(GENERATED_NAME.pattern), "generated").when(F.lower("path").rlike(MINIFIED_NAME.pattern), "minified")
    vendored = F.col("copied") | F.col("place").isNotNull() | F.col("twin").isNotNull() | (F.coalesce(F.col("mined.mined_kind"), F.lit("")) == "vendored")
    kind = F.coalesce("content_kind", F.when(F.col("mined.mined_kind") != "vendored", F.col("mined.mined_kind")), named, F.when(vendored, F.lit("vendored")))
    reason = (
        F.when(F.col("content_kind").isNotNull(), "content")
        .when(F.col("mined.mined_kind") != "vendored", F.concat(F.lit("pattern "), F.col("mined.feature")))
        .when(named.isNotNull(), "name")
        .when(F.col("copied"), "notice")
        .when(vendored, F.coalesce("place", "twin", F.concat(F.lit("pattern "), F.col("mined.feature"))))
    )
    judged = out.select(*keys, "path", "rules", kind.alias("kind"), reason.alias("reason"))
    said = judged.where("rules is not null").mapInPandas(_apply_rules, "author string, repo_name string, file_path string, kind string, reason string")
    return judged.where("rules is null").select(*keys, "kind", "reason").unionByName(said)


def _apply_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kinds, reasons = [], []
        for path, rules, kind, reason in zip(pdf["path"], pdf["rules"], pdf["kind"], pdf["reason"], strict=True):
            said = declared(path, rules)
            if any(said.values()):
                kind, reason = ("generated" if said.get("generated") else "vendored"), "declared"
            elif said.get("generated") is False and kind in ("generated", "minified", "data") or said.get("vendored") is False and kind == "vendored":
                kind, reason = None, "declared"
            kinds.append(kind)
            reasons.append(reason)
        yield pdf[["author", "repo_name", "file_path"]].assign(kind=kinds, reason=reasons)
