"""Sources: source trees, mapping files, signatures, SBOMs, records, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascadelens.functions.naming import is_header, is_library_file, is_source, is_test_path


def source_tree(spark: SparkSession, root: str, prune: bool = True) -> DataFrame:
    """author, repo, path, content of the C and C++ files below root/author%repo/.

    Libraries are read without build, test and doc folders, projects with them (prune=False). Spark's
    file listing passes over names that begin with a dot or an underscore in either case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_extract("path", r"/([^/%]+%[^/]+)/(.+)$", 2)
    key = F.regexp_extract("path", r"/([^/%]+%[^/]+)/", 1)
    listed = files.select(F.split_part(key, F.lit("%"), F.lit(1)).alias("author"), F.split_part(key, F.lit("%"), F.lit(2)).alias("repo"), below.alias("file"), "content")
    kept = listed.where((F.col("repo") != "") & is_library_file(F.col("file"), prune))
    return kept.select("author", "repo", F.col("file").alias("path"), F.decode("content", "UTF-8").alias("content"))


def tagged_sources(files: DataFrame, with_headers: bool = False) -> DataFrame:
    """Of files(path, ...) the sources outside test folders, with headers if asked for."""
    p = F.col("path")
    kind = is_source(p) | is_header(p) if with_headers else is_source(p)
    return files.where(kind & ~is_test_path(p))


def repositories(spark: SparkSession, root: str) -> DataFrame:
    """author, repo of the folders below root whose names have a percent sign and hold a file."""
    key = F.regexp_extract("path", r"/([^/%]+%[^/]+)/", 1)
    keys = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(key.alias("k")).where("k <> ''").distinct()
    return keys.select(F.split_part("k", F.lit("%"), F.lit(1)).alias("author"), F.split_part("k", F.lit("%"), F.lit(2)).alias("repo"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header line."""
    return spark.read.csv(path, header=True, schema=schema)


def library_names(spark: SparkSession, path: str) -> DataFrame:
    """tpl, tpl_name in lower case; of several names of a library the last one is kept."""
    rows = csv_table(spark, path, "tpl string, tpl_name string")
    # row numbers rise within a split of a file, and splits are told by where they begin
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("tpl", F.lower("tpl_name").alias("tpl_name"), place.alias("place")).groupBy("tpl").agg(F.max_by("tpl_name", "place").alias("tpl_name"))


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """tpl, func, src, tag, time, path of JSON files {func: [src, {tag: [time, path]}]}; tpl is the file's name."""
    name = F.regexp_replace(F.regexp_extract("_metadata.file_name", r"([^/]+)$", 1), r"\.json$", "")
    docs = spark.read.text(folder, wholetext=True).select(name.alias("tpl"), F.from_json("value", "map<string,string>").alias("m"))
    funcs = docs.select("tpl", F.explode("m").alias("func", "v")).select("tpl", "func", F.from_json("v", "array<string>").alias("v"))
    tags = funcs.select("tpl", "func", F.col("v")[0].alias("src"), F.explode(F.from_json(F.col("v")[1], "map<string,array<string>>")).alias("tag", "t"))
    return tags.select("tpl", "func", "src", "tag", F.try_to_timestamp(F.get("t", F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time"), F.get("t", F.lit(1)).alias("path"))


def sbom(spark: SparkSession, path: str) -> DataFrame:
    """repo, component, depname, version, version_op of scanner JSON {repo: {component: [{...}]}}."""
    item = "array<struct<depname:string,version:string,version_op:string>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,{item}>>").alias("m"))
    rows = docs.select(F.explode("m").alias("repo", "c")).select("repo", F.explode("c").alias("component", "d")).select("repo", "component", F.explode("d").alias("d"))
    return rows.select("repo", "component", "d.depname", "d.version", "d.version_op")


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """file, doc of the vulnerability records in `.json` files below the folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def name_map_file(spark: SparkSession, path: str) -> DataFrame:
    """cpe_key, git_key from JSON {git: cpe}, reversed; of several keys the last in the file wins."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r'"([^"]+)"\s*:\s*"[^"]*"'), F.lit(1))).alias("pos", "git_key"), "value")
    values = F.regexp_extract_all("value", F.lit(r'"[^"]+"\s*:\s*"([^"]*)"'), F.lit(1))
    return pairs.select("pos", "git_key", F.get(values, F.col("pos")).alias("cpe_key")).groupBy("cpe_key").agg(F.max_by("git_key", "pos").alias("git_key"))


def version_map(spark: SparkSession, folder: str) -> DataFrame:
    """cpe_key (the file's name), git_tag, cpe_version, pos from lines `git_tag@#@cpe_version`."""
    key = F.regexp_replace(F.regexp_extract("_metadata.file_name", r"([^/]+)$", 1), r"\.txt$", "")
    lines = spark.read.text(folder, wholetext=True).select(key.alias("cpe_key"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    parts = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), "@#@")
    return lines.where(F.size(parts) == 2).select("cpe_key", parts[0].alias("git_tag"), parts[1].alias("cpe_version"), "pos")


def patch_info(spark: SparkSession, folder: str) -> DataFrame:
    """file, cve_id, owner, repo, commit_id, pos of `*_patch_info.txt`; of a commit in a file the first line."""
    name = F.regexp_extract("_metadata.file_name", r"([^/]+)$", 1)
    lines = spark.read.option("pathGlobFilter", "*_patch_info.txt").option("recursiveFileLookup", "true").text(folder, wholetext=True).select(name.alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    w = F.split(F.trim("line"), r"\s+")
    rows = lines.where(~F.col("file").endswith("changed_patch_info.txt") & (F.size(w) >= 3)).select("file", w[0].alias("cve_id"), F.split_part(w[1], F.lit("%"), F.lit(1)).alias("owner"), F.split_part(w[1], F.lit("%"), F.lit(2)).alias("repo"), w[2].alias("commit_id"), "pos")
    first = rows.groupBy("file", "commit_id").agg(F.min(F.struct("pos", "cve_id", "owner", "repo")).alias("f"))
    return first.select("file", "f.cve_id", "f.owner", "f.repo", "commit_id", "f.pos")


def line_set(spark: SparkSession, path: str) -> DataFrame:
    """name: the distinct lines of a text file, with % as /."""
    return spark.read.text(path).select(F.translate("value", "%", "/").alias("name")).where("name <> ''").distinct()


def tag_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """tag, tag_time, of decorated log lines `DATE TIME ... tag: NAME)` or `tag: NAME, ...`; the last tag of a line.

    The time is the line's first two words, as they are; the zone behind them is left out.
    """
    tag = F.split_part(F.regexp_extract(column, r".*tag: (.*)[),]", 1), F.lit(","), F.lit(1))
    return lines.select(tag.alias("tag"), F.regexp_extract(column, r"^\s*(\S+\s+\S+)", 1).alias("tag_time"), column).where("tag <> ''")


def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """full_name, stargazers_count, page, pos of the repositories in landed pages {"items": [...]} of a search, page by page."""
    pages = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    items = F.from_json("value", "items array<struct<full_name:string,stargazers_count:bigint>>")["items"]
    return pages.select(F.col("_metadata.file_name").alias("page"), F.posexplode(items).alias("pos", "r")).select("r.full_name", "r.stargazers_count", "page", "pos")


def tag_dates(tags: DataFrame) -> DataFrame:
    """tags(..., creator_date, last_commit_date) with commit_date: the first that is there."""
    return tags.withColumn("commit_date", F.coalesce("creator_date", "last_commit_date"))
