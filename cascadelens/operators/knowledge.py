"""Edges of the knowledge graph: versions, affected versions, patches, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascadelens.functions import version as V
from cascadelens.operators import timestamps
from cascadelens.operators.ordered import along


def last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last delivered row of each non-null key (an upsert); hot keys are folded before the shuffle."""
    body = F.struct(*[F.col(c) for c in rows.columns])
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(body, F.struct(*order)).alias("r")).select("r.*")


def dated_tags(tags: DataFrame, zones: DataFrame) -> DataFrame:
    """`tags` with `at`: the instant of their free commit_date in microseconds, null where it names none."""
    records = tags.select(F.lit("lib_version").alias("tab"), F.col("lv_id").alias("row_id"), F.col("commit_date").alias("text"), "collector", "loaded_at")
    at = timestamps.normalise(records, zones).select(F.col("row_id").alias("lv_id"), F.col("utc_us").alias("at"))
    return tags.join(at, "lv_id")


def first_tags(tags: DataFrame) -> DataFrame:
    """The earliest tag of each version of a repository: author, repo_name, version, tag, commit_date, at, lv_id.

    By the instant `at`, undated tags last, ties by row id; tags without version count as one version.
    """
    order = F.struct(F.col("at").isNull().alias("undated"), F.col("at"), F.col("lv_id"))
    first = tags.groupBy("author", "repo_name", "version").agg(F.min(F.struct(order.alias("o"), "tag", "commit_date")).alias("f"))
    return first.select("author", "repo_name", "version", "f.tag", "f.commit_date", "f.o.at", "f.o.lv_id")


def version_chain(tags: DataFrame) -> DataFrame:
    """The first tags with their place in the repository's chain and the tags before and after them.

    The chain is numbered in blocks, so a repository with most of the tags runs in many tasks.
    """
    first = first_tags(tags).withColumn("undated", F.col("at").isNull())
    placed = along(first, ["author", "repo_name"], ["undated", "at", "lv_id"], ordinal="ord", lead={"precedes": "tag"}, lag={"follows": "tag"})
    return placed.drop("undated")


def mapped_tags(tags: DataFrame) -> DataFrame:
    """author, repo_name, cpe_version, git_tag, pos: the version map that tags with a known version give, in order of delivery."""
    return tags.where("version is not null").groupBy("author", "repo_name", F.col("version").alias("cpe_version"), F.col("tag").alias("git_tag")).agg(F.min("lv_id").alias("pos"))


def tags_of_versions(version_map: DataFrame) -> DataFrame:
    """author, repo_name, cpe_version, git_tags (in the map's order), first_tag."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "git_tag")))
    kept = version_map.groupBy("author", "repo_name", "cpe_version").agg(F.transform(listed, lambda x: x["git_tag"]).alias("git_tags"))
    return kept.select("*", F.col("git_tags")[0].alias("first_tag"))


def affected_exactly(matches: DataFrame, tags: DataFrame, version_map: DataFrame) -> DataFrame:
    """raw_id, author, repo_name, tag, by: versions named by matches without bounds.

    `matches`: raw_id, author, repo_name, version, si, se, ei, ee. A version of the map stands for all
    its tags, looked up by tag and repository name, of whatever author; one that the map doesn't have, for
    the tags of the repository name whose extracted version it is. `by` is `map` or `extracted`.
    """
    named = matches.where(V.is_valid(F.col("version")) & (F.concat(*[F.coalesce(b, F.lit("")) for b in ("si", "se", "ei", "ee")]) == "")).select("raw_id", "author", "repo_name", "version").distinct()
    entries = version_map.select("author", "repo_name", F.col("cpe_version").alias("version"), F.col("git_tag").alias("tag"))
    known = tags.groupBy("repo_name", "tag").agg(F.min_by("author", "lv_id").alias("owner"))
    mapped = named.join(entries, ["author", "repo_name", "version"]).join(known, ["repo_name", "tag"])
    unmapped = named.join(entries.select("author", "repo_name", "version").distinct(), ["author", "repo_name", "version"], "left_anti")
    extracted = tags.select("repo_name", "tag", F.col("author").alias("owner"), V.extract_version(F.col("tag")).alias("version")).where("version is not null")
    pick = lambda df, by: df.select("raw_id", F.col("owner").alias("author"), "repo_name", "tag", F.lit(by).alias("by"))
    return pick(mapped, "map").unionByName(pick(unmapped.join(extracted, ["repo_name", "version"]), "extracted")).distinct()


def affected_by_range(ranges: DataFrame, chain: DataFrame, mode: str = "literal", version_map: DataFrame | None = None) -> DataFrame:
    """range_id, author, repo_name, tag of the versions in each range.

    ranges: range_id, author, repo_name, si, se, ei, ee (versions). A bound means the first tag that the
    version map has for it, else for its major.minor, and else it counts as absent; an exclusive bound
    is looked at only where no inclusive one is given. A mapped tag is found in the chain by itself or by
    its extracted version. Without a map the versions of the chain are their own map.
    A start or a lone end whose tag isn't in the chain gives nothing; an end that isn't there ends
    nothing. `literal` gives an exclusive end too when the range has a start, and everything after the
    start if the end lies before it; `intended` is the half-open interval.
    """
    at = chain.where("version is not null").select("author", "repo_name", "version", "ord")
    if version_map is None:
        places = at.select("author", "repo_name", F.col("version").alias("cpe_version"), "ord")
    else:
        first = tags_of_versions(version_map).select("author", "repo_name", "cpe_version", F.col("first_tag").alias("tag")).withColumn("version", V.extract_version(F.col("tag")))
        by_tag = chain.select("author", "repo_name", "tag", F.col("ord").alias("_by_tag"))
        places = first.join(by_tag, ["author", "repo_name", "tag"], "left").join(at.withColumnRenamed("ord", "_by_version"), ["author", "repo_name", "version"], "left")
        places = places.select("author", "repo_name", "cpe_version", F.coalesce("_by_tag", "_by_version").alias("ord"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    inclusive = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    b = ranges.select("range_id", "author", "repo_name", F.coalesce(given("si"), given("se")).alias("start"), inclusive("si").alias("si_in"), F.coalesce(given("ei"), given("ee")).alias("end"), inclusive("ei").alias("ei_in"))
    for end in ("start", "end"):
        for form, key in (("exact", F.col(end)), ("near", V.major_minor(F.col(end)))):
            found = places.select("author", "repo_name", F.col("cpe_version").alias("_key"), F.struct("ord").alias(f"{end}_{form}"))
            b = b.withColumn("_key", key).join(found, ["author", "repo_name", "_key"], "left").drop("_key")
        b = b.withColumn(f"{end}_at", F.coalesce(f"{end}_exact", f"{end}_near"))
    b = b.select("range_id", "author", "repo_name", "si_in", "ei_in", "start_at", "end_at").where("start_at is not null or end_at is not null")
    j = b.join(chain.select("author", "repo_name", "tag", "ord"), ["author", "repo_name"])
    o, s, e = F.col("ord"), F.col("start_at.ord"), F.col("end_at.ord")
    from_start = (o > s) | ((o == s) & F.col("si_in"))
    to_end = (o < e) | ((o == e) & F.col("ei_in"))
    if mode == "literal":
        rule = F.when(F.col("start_at").isNull(), to_end).when(s.isNull(), False).when(e.isNull() | (e < s), from_start).when(e == s, (o == s) & F.col("ei_in")).otherwise((o <= e) & from_start)
    else:
        rule = F.when(F.col("start_at").isNull(), to_end).when(s.isNull(), False).when(e.isNull(), from_start).when((e == s) & F.col("si_in") & F.col("ei_in"), o == s).otherwise(from_start & to_end)
    return j.where(rule).select("range_id", "author", "repo_name", "tag").distinct()


def nearest_tag(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """`commits`(commit_row, repo, at) with the last tag at or before each (`tag`, Unknown if none), the first
    at or after it (`first_containing`), and how many tags of its repository contain it.

    Histories are taken to be linear. `tags`: repo, at, tag, lv_id; undated ones are left out. Tags and
    commits are merged into one order a repository, so no pair of a tag and a commit is formed.
    """
    t = tags.where("at is not null").select("repo", "at", F.lit(0).alias("k"), F.col("lv_id").alias("o"), F.col("tag").alias("t"))
    c = commits.where("at is not null").select("repo", "at", F.lit(1).alias("k"), F.col("commit_row").alias("o"), F.lit(None).cast("string").alias("t"))
    last = along(t.unionByName(c), ["repo"], ["at", "k", "o"], carried={"tag": "t"}).where("k = 1").select(F.col("o").alias("commit_row"), "tag")
    # the same walk from the end, tags of the same instant contain the commit
    turned = t.unionByName(c).select("repo", (-F.col("at")).alias("at"), "k", F.col("o"), F.when(F.col("k") == 0, F.struct((-F.col("o")).alias("o"), "t")).alias("t"))
    turned = turned.withColumn("r", F.when(F.col("k") == 0, -F.col("o")).otherwise(F.col("o")))
    numbered = along(turned.where("k = 0"), ["repo"], ["at", "r"], ordinal="n").select("repo", "at", "k", "r", "o", F.struct("n", F.col("t.t").alias("t")).alias("t"))
    both = numbered.unionByName(turned.where("k = 1").select("repo", "at", "k", "r", "o", F.lit(None).cast(numbered.schema["t"].dataType).alias("t")))
    later = along(both, ["repo"], ["at", "k", "r"], carried={"held": "t"}).where("k = 1").select(F.col("o").alias("commit_row"), F.col("held.t").alias("first_containing"), F.coalesce("held.n", F.lit(0)).alias("n_containing"))
    return last.join(later, "commit_row").select("commit_row", F.coalesce("tag", F.lit("Unknown")).alias("tag"), "first_containing", F.col("n_containing").cast("bigint").alias("n_containing"))


def version_reuse(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """reuse_id, src_id, lib_unique_id: edges to the reused library's versions that meet the condition."""
    d = V.dependency(F.col("want"))
    e = edges.where("want is not null and want <> ''").withColumn("d", d)
    j = e.join(versions.where("version is not null"), e["dst_id"] == versions["lib_key"])
    return j.where(V.satisfies(F.col("version"), F.col("d.kind"), F.col("d.base"), F.col("version_op"), F.col("d.full"))).select("reuse_id", "src_id", "lib_unique_id").distinct()


def references(docs: DataFrame, row_id: str, doc: str) -> DataFrame:
    """row_id, cve_id, pos, url, refsource, tags, published, modified of every reference of the raw records.

    References stand under `cve` or at the top; a record that isn't valid JSON has none.
    """
    item = "struct<url:string,refsource:string,tags:array<string>>"
    schema = f"cve struct<CVE_data_meta:struct<ID:string>,references:struct<reference_data:array<{item}>>>, references struct<reference_data:array<{item}>>"
    j = docs.select(row_id, F.from_json(doc, schema).alias("j"))
    listed = F.coalesce("j.cve.references.reference_data", "j.references.reference_data")
    return j.select(row_id, F.col("j.cve.CVE_data_meta.ID").alias("cve_id"), F.posexplode(listed).alias("pos", "r")).where("r.url is not null").select(row_id, "cve_id", "pos", "r.url", "r.refsource", F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"))


# Relation, whether the reference comes first, the tags that make it (none: untagged).
REFERENCE_RELATIONS = [
    ("useToPatch", True, ["Patch"]),
    ("PatchBy", False, ["Patch"]),
    ("Announce", True, []),
    ("HasExploitBy", False, ["Exploit"]),
    ("VendorReleased", True, ["Vendor Advisory"]),
    ("WillBrokenLink", False, ["Broken Link"]),
    ("GivenInformationBy", False, ["US Government Resource", "Third Party Advisory"]),
    ("Need_PermissionsRequired", False, ["Permissions Required"]),
    ("Issue_Tracking_By", False, ["Issue Tracking"]),
]


def reference_relations(refs: DataFrame) -> DataFrame:
    """rel, src, dst of the relations between vulnerabilities and references, each once."""
    made = []
    for rel, from_reference, tags in REFERENCE_RELATIONS:
        holds = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])) if tags else F.size("tags") == 0
        ends = ("url", "cve_id") if from_reference else ("cve_id", "url")
        made.append(F.when(holds, F.struct(F.lit(rel).alias("rel"), F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"))))
    every = refs.where("cve_id is not null").select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("e"))
    return every.select("e.*").distinct()


def vulnerabilities(docs: DataFrame, row_id: str, doc: str) -> DataFrame:
    """row_id and the first-class fields of a raw record: cve_id, description, problem_type, severity,
    exploitability, impact, base_score, vector, operator (of the first node), published_day, modified_day,
    lasting (days)."""
    schema = (
        "cve struct<CVE_data_meta:struct<ID:string>,description:struct<description_data:array<struct<value:string>>>,"
        "problemtype:struct<problemtype_data:array<struct<description:array<struct<value:string>>>>>>,"
        "impact struct<baseMetricV2:struct<severity:string,exploitabilityScore:double,impactScore:double,cvssV2:struct<baseScore:double,vectorString:string>>>,"
        "publishedDate string, lastModifiedDate string"
    )
    operator = F.get_json_object(doc, "$.configurations.nodes[0].operator")
    j = docs.select(row_id, F.from_json(doc, schema).alias("j"), operator.alias("operator")).where("j is not null and j.cve.CVE_data_meta.ID is not null")
    day = lambda c: F.left(F.col(c), F.lit(10))
    m = "j.impact.baseMetricV2"
    return j.select(
        row_id,
        F.col("j.cve.CVE_data_meta.ID").alias("cve_id"),
        F.get("j.cve.description.description_data", F.lit(0))["value"].alias("description"),
        F.get(F.get("j.cve.problemtype.problemtype_data", F.lit(0))["description"], F.lit(0))["value"].alias("problem_type"),
        F.col(f"{m}.severity").alias("severity"),
        F.col(f"{m}.exploitabilityScore").alias("exploitability"),
        F.col(f"{m}.impactScore").alias("impact"),
        F.col(f"{m}.cvssV2.baseScore").alias("base_score"),
        F.col(f"{m}.cvssV2.vectorString").alias("vector"),
        "operator",
        day("j.publishedDate").alias("published_day"),
        day("j.lastModifiedDate").alias("modified_day"),
        F.datediff(F.try_to_date(day("j.lastModifiedDate"), "yyyy-MM-dd"), F.try_to_date(day("j.publishedDate"), "yyyy-MM-dd")).alias("lasting"),
    )


def name_map(entries: DataFrame) -> DataFrame:
    """cpe_key, git_key: the reversed name map; of several repositories of a product the last wins."""
    return entries.where("cpe_key is not null").groupBy("cpe_key").agg(F.max_by("git_key", F.struct("pos", "git_key")).alias("git_key"))


def library_edges(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """cve_id, name: which vulnerabilities affect which libraries (product and version), each once.

    `matches`: raw_id, node_path, cpe23uri; those of a record's first node count, and only in records with
    a reference. `refs`: raw_id, cve_id.
    """
    part = lambda i: F.get(F.split("cpe23uri", ":"), F.lit(i))
    named = matches.where((F.col("node_path") == "0") & part(5).isNotNull()).select("raw_id", F.concat(part(4), part(5)).alias("name")).distinct()
    return named.join(refs.where("cve_id is not null").select("raw_id", "cve_id").distinct(), "raw_id").select("cve_id", "name").distinct()


def component_edges(components: DataFrame, software: DataFrame) -> DataFrame:
    """sbom_id, src_id, dst_id, known, version, version_op: REUSES edges from projects to their components.

    `components`: sbom_id, project (author@@repo), depname, version, version_op; `software`: unique_id, name,
    author. A component is the software of that name (the least id of several), else a new one without
    author; a project without software has no edge. Null and blank names are no components.
    """
    owners = software.where("author is not null").select(F.concat_ws("@@", "author", "name").alias("project"), F.col("unique_id").alias("src_id")).groupBy("project").agg(F.min("src_id").alias("src_id"))
    named = software.where("name is not null").groupBy(F.col("name").alias("dep")).agg(F.min("unique_id").alias("found"))
    rows = components.withColumn("dep", F.trim("depname")).where("dep <> ''")
    dst: Column = F.coalesce("found", F.concat(F.lit("None%"), "dep"))
    return rows.join(owners, "project").join(named, "dep", "left").select("sbom_id", "src_id", dst.alias("dst_id"), F.col("found").isNotNull().alias("known"), "version", "version_op")
