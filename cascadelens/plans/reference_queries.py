"""Queries of the engine's own operators, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascadelens.functions import digest
from cascadelens.functions import hashing as H
from cascadelens.functions import naming as N
from cascadelens.functions import text as T
from cascadelens.functions import version as V
from cascadelens.operators import clones, graph, knowledge, nested, tpl
from cascadelens.operators.ordered import along
from cascadelens.plans.instants_sql import instants
from cascadelens.session import scratch_path, spread, via_table
from cascadelens.sources import files, parser, sinks
from cascadelens.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL shared by several oracles -----------------------------------------------------------------
_X1 = "content"
for _p, _n in ((r"//.*", ""), (r"(?s)/\*.*?\*/", ""), (r"\s+", " "), ('"[^"]*"', '""'), ("''[^'']*''", "''''"), (r"([{};])", r" \1 ")):
    _X1 = f"regexp_replace({_X1}, '{_p}', '{_n}', 'g')"
_X1 = f"trim({_X1})"
_WORDS = ", ".join(f"'{w}'" for w in T.KEYWORDS)
_TOKENS = f"""toks AS (SELECT fs_id, regexp_extract_all({_X1}, '[\\p{{L}}\\p{{N}}_]+|[+\\-*/=<>!&|]') AS t FROM function_signature WHERE content IS NOT NULL),
tok AS (SELECT fs_id, t, i, t[i] AS x FROM (SELECT fs_id, t, unnest(range(1, len(t) + 1)) AS i FROM toks)),
feat AS (
  SELECT fs_id, CASE WHEN lower(x) IN ({_WORDS}) THEN 'keyword' WHEN regexp_full_match(x, '\\p{{L}}+') THEN 'identifier'
         WHEN NOT regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+') THEN 'operator' END AS class,
         CASE WHEN lower(x) IN ({_WORDS}) THEN lower(x) ELSE x END AS v FROM tok
), feature AS (
  SELECT fs_id, class || '_' || v AS f FROM feat WHERE class IS NOT NULL
  UNION ALL SELECT fs_id, 'bigram_' || x || '_' || t[i + 1] FROM tok WHERE i < len(t)
)"""
_SIM = f"""{_TOKENS}, bits AS (
  SELECT fs_id, h, n FROM (SELECT fs_id, f, count(*) AS n FROM feature GROUP BY 1, 2), LATERAL (SELECT ('0x' || substr(md5(f), 17, 16))::UBIGINT AS h)
), bit AS (SELECT fs_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS w FROM bits, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY 1, 2),
packed AS (SELECT fs_id, sum(CASE WHEN w > 0 THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END) AS u FROM bit GROUP BY 1),
sim AS (SELECT f.fs_id, CAST(CASE WHEN coalesce(u, 0) >= (1::HUGEINT << 63) THEN u - (1::HUGEINT << 64) ELSE coalesce(u, 0) END AS BIGINT) AS fingerprint
        FROM function_signature f LEFT JOIN packed USING (fs_id) WHERE content IS NOT NULL)"""
_FUNCS = f"""{_SIM}, funcs AS (SELECT fs_id AS id, coalesce(author, 'None') || '%' || repo_name AS repo, fingerprint, birth_time AS birth FROM sim JOIN function_signature USING (fs_id))"""
_MATCH = """hits AS (
  SELECT DISTINCT a.id, a.repo AS repo_a, b.repo AS repo_b FROM funcs a JOIN funcs b
  ON a.repo <> b.repo AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 8 AND (a.birth IS NULL OR b.birth IS NULL OR b.birth < a.birth)
), rates AS (
  SELECT repo_a, repo_b, common, total, common / total AS reuse_rate
  FROM (SELECT repo_a, repo_b, count(*) AS common FROM hits GROUP BY 1, 2) JOIN (SELECT repo AS repo_a, count(*) AS total FROM funcs GROUP BY 1) USING (repo_a)
)"""
_EV = """nullif(regexp_replace(regexp_extract({0}, '(?:[a-zA-Z_-]*[vV]?[a-zA-Z_]*[\\-_])?(\\d{{1,4}}(?:[._-]\\d{{1,4}}){{0,2}})(?:[._][a-zA-Z0-9]*[\\-_][a-zA-Z0-9]*)?', 1), '[._-]', '.', 'g'), '')"""


def _extract_version_sql(col: str) -> str:
    v = _EV.format(col)
    return f"CASE WHEN len(string_split({v}, '.')) >= 3 AND length(string_split({v}, '.')[3]) >= 4 THEN string_split({v}, '.')[1] || '.' || string_split({v}, '.')[2] ELSE {v} END"


# ---- text, hashes, fingerprints ----------------------------------------------------------------------
def _functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "function_signature")


@query(f"SELECT fs_id, {_X1} AS processed FROM function_signature")
def x1_preprocess(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d).select("fs_id", T.preprocess(F.col("content")).alias("processed"))


@query(f"WITH {_TOKENS} SELECT fs_id, f AS feature, count(*) AS n FROM feature GROUP BY 1, 2")
def x2_features(spark: SparkSession, d: str) -> DataFrame:
    return H.features(_functions(spark, d), "fs_id", "content")


@query("SELECT fs_id, bit_count(xor(simhash, CAST(fs_id * 2654435761 AS BIGINT))) AS distance FROM function_signature WHERE simhash IS NOT NULL")
def x3_hamming(spark: SparkSession, d: str) -> DataFrame:
    f = _functions(spark, d).where("simhash is not null")
    return f.select("fs_id", H.hamming(F.col("simhash"), F.col("fs_id") * F.lit(2654435761)).cast("tinyint").alias("distance"))


@query("SELECT fs_id, md5(content) AS digest, CAST(CASE WHEN u >= (1::HUGEINT << 63) THEN u - (1::HUGEINT << 64) ELSE u END AS BIGINT) AS low64 FROM (SELECT fs_id, content, ('0x' || substr(md5(content), 17, 16))::UBIGINT::HUGEINT AS u FROM function_signature)")
def x4_md5(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d).select("fs_id", F.md5(F.col("content").cast("binary")).alias("digest"), H.md5_low64(F.col("content")).alias("low64"))


_X5 = r"""SELECT fs_id, CAST(pos AS INT) AS pos, list[pos] AS func FROM (
  SELECT fs_id, list, unnest(range(1, len(list) + 1)) AS pos FROM (
    SELECT fs_id, regexp_extract_all(content, '(?:^|\n)([a-zA-Z_][a-zA-Z0-9_]*\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)\s*\{[^}]*\})', 1) AS list FROM function_signature))"""


@query(f"SELECT * FROM ({_X5}) WHERE length(trim(func, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) >= 50")
def x5_functions_in_source(spark: SparkSession, d: str) -> DataFrame:
    found = _functions(spark, d).select("fs_id", F.posexplode(T.extracted_functions(F.col("content"))).alias("p", "func"))
    return found.where(F.length(F.regexp_replace("func", r"^\s+|\s+$", "")) >= 50).select("fs_id", (F.col("p") + 1).alias("pos"), "func")


_X6 = r"""WITH RECURSIVE f AS (SELECT fs_id, content, regexp_extract_all(content, '(?:^|\n)([a-zA-Z_][a-zA-Z0-9_]*\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)\s*\{[^}]*\})', 0) AS list FROM function_signature),
spot AS (SELECT fs_id, content, list, 1 AS k, strpos(content, list[1]) AS p FROM f WHERE len(list) > 0
  UNION ALL SELECT fs_id, content, list, k + 1, p + length(list[k]) - 1 + strpos(substr(content, p + length(list[k])), list[k + 1]) FROM spot WHERE k < len(list)),
put AS (SELECT fs_id, k, ltrim(list[k], chr(10)) AS func, left(content, p - 1 + length(list[k]) - length(ltrim(list[k], chr(10)))) AS before FROM spot)
SELECT fs_id, CAST(k AS INT) AS pos, func, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) AS line_no FROM put"""


@query(_X6)
def x6_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Line on which each extracted function begins; of equal ones each has its own."""
    f = _functions(spark, d).select("fs_id", F.posexplode(T.placed_functions(F.col("content"))).alias("p", "f"))
    return f.select("fs_id", (F.col("p") + 1).alias("pos"), "f.func", "f.line_no")


@query()
def x22_parsed_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions by matching brackets, with name, first line and hash."""
    return parser.functions_in(spread(_functions(spark, d).select("fs_id", "content")), "fs_id", "content")


@query()
def x20_macros(spark: SparkSession, d: str) -> DataFrame:
    """String macros and stringizing macros of each text, and the text with the former replaced."""
    return parser.replaced_macros(spread(_functions(spark, d).select("fs_id", "content")), "fs_id", "content")


@query()
def x19_digests(spark: SparkSession, d: str) -> DataFrame:
    """Locality-sensitive digest of each text, and its distance from that of the text before it in its file."""
    f = via_table(digest.digests(spread(_functions(spark, d).select("fs_id", "content", "file_path", "repo_name"))), "digests")
    near = along(f, ["repo_name", "file_path"], ["fs_id"], lag={"before": "digest"})
    far = digest.distance(F.col("digest"), F.col("before"))
    return near.select("fs_id", "digest", far.alias("distance"), digest.is_similar(far).alias("similar"))


@query(f"WITH {_SIM} SELECT fs_id, fingerprint FROM sim")
def a5_simhash(spark: SparkSession, d: str) -> DataFrame:
    return H.simhash(_functions(spark, d), "fs_id", "content")


_X16 = r"""regexp_replace(content, '(?ms)("(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*'')|//[^\n]*|/\*.*?\*/', '\1', 'g')"""
_X16 = f"array_to_string(list_filter(list_transform(string_split({_X16}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


@query(f"SELECT fs_id, {_X16} AS cleaned, CAST(length({_X16}) - length(replace({_X16}, chr(10), '')) + 1 AS INT) AS n_lines, sha256(content) AS raw_hash, sha256(regexp_replace({_X16}, '[\\s{{}}]', '', 'g')) AS norm_hash FROM function_signature WHERE content IS NOT NULL")
def x16_clean_hash(spark: SparkSession, d: str) -> DataFrame:
    """Code without comments, its lines, and the hashes of raw and normalised text."""
    c = T.without_comments(F.col("content"))
    lines = F.length(c) - F.length(F.regexp_replace(c, "\n", "")) + 1
    return _functions(spark, d).where("content is not null").select("fs_id", c.alias("cleaned"), lines.alias("n_lines"), F.sha2("content", 256).alias("raw_hash"), F.sha2(T.normalized(c), 256).alias("norm_hash"))


_HUGE = "content || repeat('0x1f, ', 9999 + fs_id % 3) || 'end' || CASE WHEN fs_id % 7 = 0 THEN '# E-mail..................: [Ciph3r_blackhat@yahoo.com]' ELSE '' END"


@query(
    f"""SELECT fs_id, CASE WHEN fs_id % 7 = 0 THEN 0 WHEN fs_id % 3 = 0 THEN length(t) ELSE length(regexp_replace(content, '[0-9a-fA-FxX\\s]+$', '')) + 4 END AS n_chars,
    md5(CASE WHEN fs_id % 7 = 0 THEN '' WHEN fs_id % 3 = 0 THEN t ELSE regexp_replace(content, '[0-9a-fA-FxX\\s]+$', '') || ' end' END) AS digest FROM (SELECT fs_id, content, {_HUGE} AS t FROM function_signature)"""
)
def x21_huge_arrays(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each text behind which 9,999 to 10,001 constants, and every seventh time the mark, are put."""
    end = F.when(F.col("fs_id") % 7 == 0, F.lit(T.BLACKLISTED)).otherwise("")
    longer = F.concat("content", F.repeat(F.lit("0x1f, "), (F.lit(9999) + F.col("fs_id") % 3).cast("int")), F.lit("end"), end)
    left = T.without_huge_arrays(F.col("t"))
    return _functions(spark, d).select("fs_id", longer.alias("t")).select("fs_id", F.length(left).cast("bigint").alias("n_chars"), F.md5(left.cast("binary")).alias("digest"))


@query("SELECT fs_id, printf('%02dh %02dm %02ds', fs_id * 37 // 3600, fs_id * 37 // 60 % 60, fs_id * 37 % 60) AS spent FROM function_signature")
def x28_durations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds as hours, minutes and seconds."""
    return _functions(spark, d).select("fs_id", T.duration(F.col("fs_id") * 37).alias("spent"))


# ---- versions, CPE names, paths ------------------------------------------------------------------------
@query(f"SELECT lv_id, {_extract_version_sql('tag')} AS extracted FROM lib_version")
def x7_extract_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lib_version").select("lv_id", V.extract_version(F.col("tag")).alias("extracted"))


@query(r"SELECT lv_id, string_split(version, '.')[1] || '.' || coalesce(string_split(version, '.')[2], '0') AS two_part, regexp_extract(version, '^(\d+\.\d+)', 1) AS major_minor, coalesce(regexp_full_match(version, '\d+(\.\d+){0,2}'), false) AS valid FROM lib_version")
def x8_version_parts(spark: SparkSession, d: str) -> DataFrame:
    """major.minor in both forms, and validity."""
    v = F.col("version")
    return table(spark, d, "lib_version").select("lv_id", V.two_part(v).alias("two_part"), V.major_minor(v).alias("major_minor"), F.coalesce(V.is_valid(v), F.lit(False)).alias("valid"))


_DEP = r"""SELECT reuse_id, src_id, dst_id, version_op, version AS want,
  CASE WHEN regexp_matches(version, '^\^(\d+)\.(\d+)(\.\d+)?$') THEN '^' WHEN regexp_matches(version, '^~(\d+\.\d+)(\.\d+)?$') THEN '~' END AS kind FROM reuses"""
_DEP = rf"""SELECT *, CASE kind WHEN '^' THEN regexp_extract(want, '^\^(\d+)', 1) WHEN '~' THEN regexp_extract(want, '^~(\d+\.\d+)', 1) ELSE want END AS base,
  CASE WHEN kind IS NOT NULL THEN regexp_extract(substr(want, 2), '^(\d+\.\d+(?:\.\d+)?)', 1) ELSE want END AS full_version FROM ({_DEP})"""


@query(f"SELECT reuse_id, kind, base, full_version FROM ({_DEP})")
def x9_version_dependency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reuses").select("reuse_id", V.dependency(F.col("version")).alias("d")).select("reuse_id", "d.kind", "d.base", F.col("d.full").alias("full_version"))


@query(
    """WITH n AS (SELECT lv_id, version, lag(version) OVER (PARTITION BY author, repo_name ORDER BY lv_id) AS other,
       list_transform(string_split(version, '.'), lambda x: coalesce(try_cast(x AS INT), 0)) AS a FROM lib_version)
    SELECT lv_id, other, version, CAST(CASE WHEN list_transform(string_split(other, '.'), lambda x: coalesce(try_cast(x AS INT), 0)) < a THEN -1 ELSE 1 END AS INT) AS cmp FROM n WHERE other IS NOT NULL AND version IS NOT NULL"""
)
def x12_compare_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each version against the one delivered before it in its repository."""
    rows = table(spark, d, "lib_version").select("author", "repo_name", "lv_id", "version")
    n = along(rows, ["author", "repo_name"], ["lv_id"], lag={"other": "version"}).where("other is not null and version is not null")
    return n.select("lv_id", "other", "version", V.compare(F.col("other"), F.col("version")).alias("cmp"))


_CPE = r"'^cpe:2\.3:([aho]):([^:]+):([^:]+):([^:]+)'"


@query(f"SELECT ref_id, {', '.join(f'CASE WHEN regexp_matches(cpe23uri, {_CPE}) THEN regexp_extract(cpe23uri, {_CPE}, {i}) END AS {n}' for i, n in enumerate(('part', 'vendor', 'product', 'version'), 1))}, string_split(cpe23uri, ':')[4] AS split_vendor FROM git2cpe")
def x13_parse_cpe(spark: SparkSession, d: str) -> DataFrame:
    """CPE names by pattern and by splitting."""
    u = F.col("cpe23uri")
    return table(spark, d, "git2cpe").select("ref_id", N.parsed_cpe(u).alias("p"), N.cpe_part(u, 3).alias("split_vendor")).select("ref_id", "p.*", "split_vendor")


_TESTS = ", ".join(f"'{x}'" for x in N.TEST_NAMES)
_PRUNED = ", ".join(f"'{x}'" for x in N.PRUNED_FOLDERS)


@query(
    rf"""SELECT fs_id, len(list_intersect(string_split(lower(file_path), '/'), [{_TESTS}])) > 0 AS is_test, regexp_matches(lower(file_path), '\.(cc|c|cpp|cxx|c\+\+|cp|cci)$') AS is_source,
    regexp_matches(file_path, '\.(h|hpp)$') AS is_header, regexp_matches(file_path, '\.(c|cpp|cc|cxx|h|hpp)$') AND len(list_filter(string_split(file_path, '/')[:-2], lambda s: s IN ({_PRUNED}) OR regexp_matches(s, '^\.[^./]'))) = 0 AS in_library,
    regexp_matches(file_path, '\.(c|cpp|cc|cxx|h|hpp)$') AS in_project, string_split(regexp_replace(lower(file_path), '([^/])\.[^./]*$', '\1'), '/') AS segments FROM function_signature"""
)
def f4_path_filters(spark: SparkSession, d: str) -> DataFrame:
    """Path predicates and segments (SC1, SC2, F4, F5, F6, X24)."""
    p = F.col("file_path")
    return _functions(spark, d).select("fs_id", N.is_test_path(p).alias("is_test"), N.is_source(p).alias("is_source"), N.is_header(p).alias("is_header"), N.is_library_file(p).alias("in_library"), N.is_library_file(p, prune=False).alias("in_project"), N.path_segments(p).alias("segments"))


@query("SELECT software_row, unique_id, coalesce(author, 'None') || '%' || name AS made, CASE WHEN len(string_split(unique_id, '%')) = 2 THEN string_split(unique_id, '%')[1] END AS key_author, CASE WHEN len(string_split(unique_id, '%')) = 2 THEN string_split(unique_id, '%')[2] END AS key_name FROM software")
def x25_repo_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys made and split."""
    s = table(spark, d, "software").withColumn("k", N.split_repo_key(F.col("unique_id")))
    return s.select("software_row", "unique_id", N.repo_key(F.col("author"), F.col("name")).alias("made"), F.col("k.author").alias("key_author"), F.col("k.name").alias("key_name"))


# ---- clones --------------------------------------------------------------------------------------------
def _clone_functions(spark: SparkSession, d: str) -> DataFrame:
    f = _functions(spark, d)
    sim = H.simhash(f, "fs_id", "content")
    keyed = f.select("fs_id", N.repo_key(F.col("author"), F.col("repo_name")).alias("repo"), F.col("birth_time").alias("birth")).join(sim, "fs_id")
    return via_table(keyed.select(F.col("fs_id").alias("id"), "repo", "fingerprint", "birth"), "fingerprints")


@query(f"WITH {_FUNCS}, {_MATCH} SELECT id, repo_a, repo_b FROM hits")
def j1_similar_functions(spark: SparkSession, d: str) -> DataFrame:
    f = _clone_functions(spark, d)
    return clones.similar_functions(f, f)


@query(f"WITH {_FUNCS}, {_MATCH} SELECT * FROM rates")
def a2_reuse_rates(spark: SparkSession, d: str) -> DataFrame:
    f = _clone_functions(spark, d)
    return clones.reuse_rates(f, clones.similar_functions(f, f))


@query(f"WITH {_FUNCS}, {_MATCH} SELECT *, CAST(0.1 AS DOUBLE) AS adaptive_threshold FROM rates WHERE reuse_rate >= 0.1")
def f3_reuse_relations(spark: SparkSession, d: str) -> DataFrame:
    """Reuse relations of all pairs of repositories, without statistics of earlier runs."""
    f = _clone_functions(spark, d)
    return clones.reuse_relations(clones.reuse_rates(f, clones.similar_functions(f, f)))


_STATS = """stats AS (SELECT repo AS repo_b, functions, coalesce(reused, 0) AS reused FROM (SELECT repo, count(*) AS functions FROM funcs GROUP BY 1) LEFT JOIN (SELECT repo_b AS repo, sum(common)::BIGINT AS reused FROM rates GROUP BY 1) USING (repo)),
judged AS (SELECT *, CASE WHEN reused > 0 THEN greatest(0.01::DOUBLE, least(1.0::DOUBLE, functions / reused)) ELSE 0.1::DOUBLE END AS threshold FROM stats)"""


@query(f"WITH {_FUNCS}, {_MATCH}, {_STATS} SELECT repo_b, reused, functions, threshold FROM judged")
def a3_adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Reuses of each repository's functions by others, and the threshold they give (A3, A4)."""
    f = _clone_functions(spark, d)
    s = clones.reuse_statistics(f, clones.reuse_rates(f, clones.similar_functions(f, f)))
    return s.withColumn("threshold", clones.adaptive_threshold(F.col("reused"), F.col("functions")))


@query(f"WITH {_FUNCS}, {_MATCH}, {_STATS} SELECT r.*, threshold AS adaptive_threshold FROM rates r JOIN judged USING (repo_b) WHERE reuse_rate >= greatest(0.1::DOUBLE, threshold)")
def f3_adapted_relations(spark: SparkSession, d: str) -> DataFrame:
    """Reuse relations at the thresholds that the statistics of these very matches give."""
    f = _clone_functions(spark, d)
    rates = via_table(clones.reuse_rates(f, clones.similar_functions(f, f)), "rates")
    return clones.reuse_relations(rates, clones.reuse_statistics(f, rates))


@query(f"SELECT tpl, func, arg_max(file_path, fs_id) AS last_path, count(*) AS n FROM (SELECT coalesce(author, 'None') || '%' || repo_name AS tpl, fs_id, file_path, sha256(regexp_replace({_X16}, '[\\s{{}}]', '', 'g')) AS func FROM function_signature WHERE content IS NOT NULL) GROUP BY 1, 2")
def a22_signature_groups(spark: SparkSession, d: str) -> DataFrame:
    """Functions of a library by the hash of their normalised text; the last path wins."""
    return _hashed(spark, d).groupBy("tpl", "func").agg(F.max_by("path", "fs_id").alias("last_path"), F.count(F.lit(1)).alias("n"))


@query("SELECT author, repo_name, count(*) AS n_functions, count(DISTINCT md5_hash) AS n_hashes, count(DISTINCT file_path) AS n_files, CAST(epoch_us(min(birth_time)) AS VARCHAR) AS first_birth_us FROM function_signature GROUP BY 1, 2")
def a1_library_counts(spark: SparkSession, d: str) -> DataFrame:
    """The feature library in numbers."""
    return _functions(spark, d).groupBy("author", "repo_name").agg(F.count(F.lit(1)).alias("n_functions"), F.count_distinct("md5_hash").alias("n_hashes"), F.count_distinct("file_path").alias("n_files"), F.unix_micros(F.min("birth_time")).cast("string").alias("first_birth_us"))


@query("SELECT repo, path, epoch_us(min(commit_ts)) AS born_us, count(*) AS n_commits FROM commit_log WHERE commit_ts IS NOT NULL AND op = 'upsert' GROUP BY 1, 2")
def sc19_file_births(spark: SparkSession, d: str) -> DataFrame:
    """Birth of every file by its earliest commit (SC19)."""
    c = table(spark, d, "commit_log").where("commit_ts is not null and op = 'upsert'")
    return c.groupBy("repo", "path").agg(F.unix_micros(F.min("commit_ts")).alias("born_us"), F.count(F.lit(1)).alias("n_commits"))


@query("SELECT sbom_id, project, depname, version, version_op FROM sbom_component WHERE trim(depname) <> '' AND version <> ''")
def f8_sbom_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Flattened SBOM rows with a name and a version (SC8, SC9, F8)."""
    return table(spark, d, "sbom_component").where("trim(depname) <> '' and version <> ''").select("sbom_id", "project", "depname", "version", "version_op")


# ---- libraries -----------------------------------------------------------------------------------------
_SIG = f"sig AS (SELECT coalesce(author, 'None') || '%' || repo_name AS tpl, sha256(regexp_replace({_X16}, '[\\s{{}}]', '', 'g')) AS func, birth_time AS time, file_path AS path FROM function_signature WHERE content IS NOT NULL)"
_BIRTH = f"""{_SIG}, birth AS (SELECT func, tpl, o.time AS born, o.path AS path FROM (SELECT func, tpl, arg_min(struct_pack(time := time, path := path), (time IS NULL, time, path)) AS o FROM sig GROUP BY 1, 2)),
nm AS (SELECT DISTINCT tpl, lower(split_part(tpl, '%', 2)) AS tpl_name FROM sig)"""
_EXT, _BLACK = ", ".join(f"'{x}'" for x in tpl.EXTERN_FLAG), ", ".join(f"'{x}'" for x in tpl.BLACK_SET)
_HELD = rf"""{_BIRTH}, held AS (
  SELECT *, len(list_intersect(segments, [{_EXT}])) > 0 AS external FROM (
    SELECT b.*, tpl_name, holders, list_distinct(string_split(regexp_replace(lower(path), '([^/])\.[^./]*$', '\1'), '/')) AS segments
    FROM birth b JOIN (SELECT func, count(*) AS holders FROM birth GROUP BY 1 HAVING count(*) > 1) USING (func) LEFT JOIN nm USING (tpl))
), votes AS (SELECT func, segment, count(*) AS votes FROM (SELECT func, tpl, tpl_name, unnest(segments) AS segment FROM held) WHERE segment NOT IN ({_BLACK}) AND segment IS DISTINCT FROM tpl_name GROUP BY 1, 2)"""
_ORIGIN = f"""{_HELD}, enough AS (SELECT v.* FROM votes v JOIN (SELECT DISTINCT func, holders FROM held) USING (func) WHERE votes >= CASE WHEN holders <= 3 THEN 1 ELSE 2 END),
own AS (SELECT * FROM held WHERE NOT external),
voted AS (SELECT func, arg_min(o.tpl, (born IS NULL, born, o.tpl)) AS origin FROM own o JOIN enough e USING (func) WHERE e.segment = o.tpl_name GROUP BY 1),
timed AS (SELECT func, arg_min(struct_pack(tpl := tpl, born := born), (born IS NULL, born, tpl)) AS o FROM own GROUP BY 1),
origin AS (SELECT func, coalesce(origin, o.tpl) AS origin, CASE WHEN origin IS NULL THEN o.born END AS origin_time, origin IS NOT NULL AS by_path FROM timed FULL JOIN voted USING (func) WHERE coalesce(origin, o.tpl) IS NOT NULL)"""
_REUSED = f"""{_ORIGIN}, reused AS (SELECT DISTINCT tpl AS s, origin AS x, func FROM birth JOIN origin USING (func) WHERE tpl <> origin AND (by_path OR origin_time < born))"""
_EDGES = f"""{_REUSED}, joined AS (
  SELECT s, x, n, n_x, coalesce(r_x, 0) AS r_x FROM (SELECT s, x, count(*) AS n FROM reused GROUP BY 1, 2) JOIN (SELECT tpl AS x, count(*) AS n_x FROM birth GROUP BY 1) USING (x)
  LEFT JOIN (SELECT s AS x, count(DISTINCT func) AS r_x FROM reused GROUP BY 1) USING (x) WHERE n_x - coalesce(r_x, 0) >= 1
), edges AS (SELECT * FROM joined WHERE n / (n_x - r_x) >= 0.01),
kept AS (SELECT e.* FROM edges e LEFT JOIN edges b ON b.s = e.x AND b.x = e.s WHERE b.n IS NULL OR e.n > b.n)"""


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """tpl, func (hash of the normalised text), time, path, fs_id of every function with a text."""
    f = spread(_functions(spark, d).where("content is not null").select("fs_id", "author", "repo_name", "birth_time", "file_path", "content"))
    func = F.sha2(T.normalized(T.without_comments(F.col("content"))), 256)
    return f.select(N.repo_key(F.col("author"), F.col("repo_name")).alias("tpl"), func.alias("func"), F.col("birth_time").alias("time"), F.col("file_path").alias("path"), "fs_id")


def _signatures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sig = via_table(_hashed(spark, d).drop("fs_id"), "signatures")
    births = tpl.first_seen(sig)
    names = sig.select("tpl", F.lower(F.split_part("tpl", F.lit("%"), F.lit(2))).alias("tpl_name")).distinct()
    return births, names


@query(f"WITH {_BIRTH} SELECT func, tpl, CAST(epoch_us(born) AS VARCHAR) AS born_us, path FROM birth")
def a6_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d)[0].select("func", "tpl", F.unix_micros("born").cast("string").alias("born_us"), "path")


@query(f"WITH {_HELD} SELECT func, segment, votes FROM votes")
def a7_path_votes(spark: SparkSession, d: str) -> DataFrame:
    return tpl.path_votes(*_signatures(spark, d))


@query(f"WITH {_ORIGIN} SELECT func, origin, CAST(epoch_us(origin_time) AS VARCHAR) AS origin_us, by_path FROM origin")
def a8_origins(spark: SparkSession, d: str) -> DataFrame:
    return tpl.origins(*_signatures(spark, d)).select("func", "origin", F.unix_micros("origin_time").cast("string").alias("origin_us"), "by_path")


def _reused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    births, names = _signatures(spark, d)
    births = via_table(births, "births")
    return births, via_table(tpl.reused_functions(births, tpl.origins(births, names)), "reused")


@query(f"WITH {_REUSED} SELECT s, x, func FROM reused")
def j2_reused_functions(spark: SparkSession, d: str) -> DataFrame:
    return _reused(spark, d)[1]


@query(f"WITH {_REUSED} SELECT s, count(DISTINCT func) AS n_functions, count(DISTINCT x) AS n_origins FROM reused GROUP BY 1")
def a9_reused_counts(spark: SparkSession, d: str) -> DataFrame:
    return _reused(spark, d)[1].groupBy("s").agg(F.count_distinct("func").alias("n_functions"), F.count_distinct("x").alias("n_origins"))


@query(f"WITH {_EDGES} SELECT s, x, n, n_x, r_x FROM joined WHERE n * r_x >= 0.01 * n_x * n_x")
def a10_recalled_edges(spark: SparkSession, d: str) -> DataFrame:
    return tpl.recalled_edges(*_reused(spark, d))


@query(f"WITH {_EDGES} SELECT s, x, n, n_x, r_x FROM edges")
def a10_recalled_edges_intended(spark: SparkSession, d: str) -> DataFrame:
    return tpl.recalled_edges(*_reused(spark, d), mode="intended")


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    return tpl.one_direction(tpl.recalled_edges(*_reused(spark, d), mode="intended"))


@query(f"WITH {_EDGES} SELECT s, x, n, n_x, r_x FROM kept")
def s6_one_direction(spark: SparkSession, d: str) -> DataFrame:
    return _dependencies(spark, d)


@query(f"WITH {_EDGES}, ids AS (SELECT s AS id FROM kept UNION SELECT x FROM kept) SELECT id, round(coalesce(w, 0) / (SELECT count(*) - 1 FROM ids), 9) AS in_degree FROM ids LEFT JOIN (SELECT x AS id, sum(n / n_x) AS w FROM kept GROUP BY 1) USING (id)")
def a11_in_degree(spark: SparkSession, d: str) -> DataFrame:
    e = _dependencies(spark, d).withColumn("w", F.col("n") / F.col("n_x"))
    return graph.in_degree_centrality(e, "s", "x", "w").select("id", F.round("in_degree", 9).alias("in_degree"))


# rounds enough for the digits given; a node without outgoing edges leads to all
_RANKS = f"""WITH RECURSIVE {_EDGES}, ids AS (SELECT s AS id FROM kept UNION SELECT x FROM kept), total AS (SELECT s, sum(n / n_x) AS t FROM kept GROUP BY 1), size AS (SELECT count(*) AS k FROM ids),
ways AS (SELECT a.id AS s, b.id AS x, 0.15 / k + 0.85 * CASE WHEN t IS NULL THEN 1.0 / k ELSE coalesce(w, 0) / t END AS p FROM ids a, ids b, size LEFT JOIN total ON total.s = a.id LEFT JOIN (SELECT s, x, sum(n / n_x) AS w FROM kept GROUP BY 1, 2) e ON e.s = a.id AND e.x = b.id),
rank AS (SELECT 0 AS turn, id, 1.0::DOUBLE / k AS r FROM ids, size UNION ALL SELECT turn + 1, x, sum(r * p) FROM rank JOIN ways ON s = id WHERE turn < 200 GROUP BY turn, x)"""


@query(f"{_RANKS} SELECT id, round(r, 6) AS rank FROM rank WHERE turn = 200")
def a12_pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = via_table(_dependencies(spark, d).withColumn("w", F.col("n") / F.col("n_x")), "edges")
    return graph.pagerank(e, "s", "x", "w").select("id", F.round("rank", 6).alias("rank"))


@query(f"{_RANKS}, degree AS (SELECT id, coalesce(w, 0) / nullif((SELECT k - 1 FROM size), 0) AS d FROM ids LEFT JOIN (SELECT x AS id, sum(n / n_x) AS w FROM kept GROUP BY 1) USING (id)) SELECT k.s AS origin_tpl_uuid, k.x AS reuse_tpl_uuid FROM kept k JOIN degree a ON a.id = k.s JOIN degree b ON b.id = k.x JOIN rank r ON r.id = k.x AND turn = 200 WHERE NOT coalesce(a.d > 0.05 AND r.r / nullif(b.d, 0) > 0.5, false)")
def f19_pruned_edges(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies after pruning by centrality, at limits low enough that some go (F19, SK6's columns)."""
    e = via_table(_dependencies(spark, d).withColumn("w", F.col("n") / F.col("n_x")), "edges")
    kept = tpl.prune_by_centrality(e, graph.in_degree_centrality(e, "s", "x", "w"), graph.pagerank(e, "s", "x", "w"), in_degree=0.05, ratio=0.5)
    return kept.select(F.col("s").alias("origin_tpl_uuid"), F.col("x").alias("reuse_tpl_uuid"))


@query(f"WITH {_EDGES}, c AS (SELECT (SELECT count(*) FROM (SELECT s, x FROM kept INTERSECT SELECT s, x FROM reused)) AS tp, (SELECT count(*) FROM kept) AS n_found, (SELECT count(*) FROM (SELECT DISTINCT s, x FROM reused)) AS n_truth) SELECT tp, n_found, n_truth, tp / n_found AS precision, tp / n_truth AS recall, 2 * (tp / n_found) * (tp / n_truth) / (tp / n_found + tp / n_truth) AS f1 FROM c")
def a14_score(spark: SparkSession, d: str) -> DataFrame:
    """Kept dependencies against all reuse pairs."""
    births, reused = _reused(spark, d)
    kept = tpl.one_direction(tpl.recalled_edges(births, reused, mode="intended"))
    return tpl.score(kept, reused)


# ---- graph of reuses -----------------------------------------------------------------------------------
_LINKS = "links AS (SELECT DISTINCT src_id AS s, dst_id AS x FROM reuses WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)"
_LEVELS = f"""{_LINKS}, l AS (SELECT * FROM links WHERE s <> x), ids AS (SELECT s AS root FROM l UNION SELECT x FROM l),
d1 AS (SELECT x AS root, s AS d1 FROM l), d2 AS (SELECT root, l.s AS d2 FROM d1 JOIN l ON l.x = d1.d1), d3 AS (SELECT root, l.s AS d3 FROM d2 JOIN l ON l.x = d2.d2),
levels AS (SELECT root, 1::BIGINT AS paths_1, coalesce(p2, 0) AS paths_2, coalesce(p3, 0) AS paths_3, coalesce(u1, 0) AS dependents_1, coalesce(u2, 0) AS dependents_2, coalesce(u3, 0) AS dependents_3
  FROM ids LEFT JOIN (SELECT root, count(*) AS p2, count(DISTINCT d1) AS u1 FROM d1 GROUP BY 1) USING (root)
  LEFT JOIN (SELECT root, count(*) AS p3, count(DISTINCT d2) AS u2 FROM d2 GROUP BY 1) USING (root) LEFT JOIN (SELECT root, count(DISTINCT d3) AS u3 FROM d3 GROUP BY 1) USING (root))"""


@query(f"WITH RECURSIVE {_LINKS}, p AS (SELECT s AS root, s AS id, 0 AS level, [s] AS path FROM (SELECT s FROM links EXCEPT SELECT x FROM links) UNION ALL SELECT root, l.x, level + 1, list_append(path, l.x) FROM p JOIN links l ON l.s = p.id WHERE NOT list_contains(path, l.x)) SELECT root, id, CAST(level AS INT) AS level, path FROM p")
def g1_dependency_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every path from the ids that nobody reuses from."""
    r = table(spark, d, "reuses").where("src_id is not null and dst_id is not null")
    roots = r.select(F.col("src_id").alias("id")).distinct().join(r.select(F.col("dst_id").alias("id")), "id", "left_anti")
    return graph.paths_from(r, "src_id", "dst_id", roots)


@query(f"WITH {_LEVELS} SELECT * FROM levels")
def g2_dependents_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Dependents per level: paths and distinct ids."""
    return graph.dependents_by_level(table(spark, d, "reuses"), "src_id", "dst_id")


@query(f"WITH {_LEVELS} SELECT root, dependents_1, dependents_2, dependents_3 FROM levels ORDER BY dependents_2 + dependents_3 DESC, root LIMIT 10")
def g3_top_dependents(spark: SparkSession, d: str) -> DataFrame:
    """The ten ids with most dependents at two and three hops."""
    return graph.top_dependents(graph.dependents_by_level(table(spark, d, "reuses"), "src_id", "dst_id"))


# every simple cycle, from its least id
_CYCLES = f"""WITH RECURSIVE {_LINKS}, walk AS (SELECT s AS top, x AS id, [s, x] AS path FROM links WHERE x >= s
  UNION ALL SELECT top, x, list_append(path, x) FROM walk JOIN links ON s = id WHERE id <> top AND x >= top AND (x = top OR NOT list_contains(path, x))),
ring AS (SELECT path, unnest(range(1, len(path))) AS i FROM walk WHERE id = top)"""


@query(f"{_CYCLES} SELECT path[i] AS s, path[i + 1] AS x, count(*) AS n_cycles FROM ring GROUP BY 1, 2")
def g5_cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    """How many simple cycles each edge is on."""
    return graph.cycle_edges(table(spark, d, "reuses"), "src_id", "dst_id")


@query()
def g5_without_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a greedy cut of all cycles takes out, and those it leaves."""
    return graph.without_cycles(table(spark, d, "reuses"), "src_id", "dst_id")


@query(f"WITH RECURSIVE {_LINKS}, both_ways AS (SELECT s AS a, x AS b FROM links UNION SELECT x, s FROM links), ids AS (SELECT a AS id FROM both_ways), near AS (SELECT id, id AS component FROM ids UNION SELECT b, component FROM near JOIN both_ways ON a = id) SELECT id, min(component) AS component FROM near GROUP BY 1")
def g8_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the reuse graph."""
    return graph.connected_components(table(spark, d, "reuses"), "src_id", "dst_id")


# ---- knowledge graph -----------------------------------------------------------------------------------
_LIB_DATES = instants("SELECT 'lib_version' AS tab, lv_id AS row_id, commit_date AS txt, collector, loaded_at FROM lib_version")
_CHAIN = f"""{_LIB_DATES}, dated AS (SELECT l.*, readings[1] AS at_us FROM lib_version l LEFT JOIN inst ON row_id = lv_id),
firsts AS (SELECT author, repo_name, version, arg_min(struct_pack(tag := tag, commit_date := commit_date, at_us := at_us, lv_id := lv_id), (at_us IS NULL, at_us, lv_id)) AS f FROM dated GROUP BY 1, 2, 3),
chain AS (SELECT author, repo_name, version, f.tag AS tag, f.commit_date AS commit_date, f.lv_id AS lv_id, row_number() OVER w AS ord, lead(f.tag) OVER w AS precedes, lag(f.tag) OVER w AS follows
  FROM firsts WINDOW w AS (PARTITION BY author, repo_name ORDER BY f.at_us IS NULL, f.at_us, f.lv_id))"""


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return via_table(knowledge.dated_tags(table(spark, d, "lib_version"), table(spark, d, "zone_ref")), "tags")


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.version_chain(_dated(spark, d))


@query(f"WITH {_CHAIN} SELECT author, repo_name, version, tag, commit_date, lv_id FROM chain")
def w2_first_tags(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.first_tags(_dated(spark, d)).drop("at")


@query(f"WITH {_CHAIN} SELECT * FROM chain")
def w1_version_chain(spark: SparkSession, d: str) -> DataFrame:
    """PRECEDES and FOLLOWS between the versions of a repository."""
    return _chain(spark, d).drop("at")


@query("""SELECT lv_id, tag, row_number() OVER w AS place, row_number() OVER w = 1 AS latest FROM (SELECT *, array_to_string(list_transform(regexp_extract_all(tag, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(regexp_replace(x, '^0+([0-9])', '\\1'), 20, '0') ELSE x END), '') AS key FROM lib_version)
  WINDOW w AS (PARTITION BY author, repo_name ORDER BY key DESC, lv_id)""")
def sc17_tags_by_version(spark: SparkSession, d: str) -> DataFrame:
    """The tags of each repository, the latest version first (SC17, T8)."""
    t = table(spark, d, "lib_version").select("author", "repo_name", "tag", "lv_id", V.sort_key(F.col("tag")).alias("key")).withColumn("turned", -F.col("lv_id"))
    up = along(t, ["author", "repo_name"], ["key", "turned"], ordinal="n")
    most = up.groupBy("author", "repo_name").agg(F.max("n").alias("most")).select(F.col("author").alias("_a"), F.col("repo_name").alias("_r"), "most")
    placed = up.join(most, up["author"].eqNullSafe(most["_a"]) & up["repo_name"].eqNullSafe(most["_r"]))
    return placed.select("lv_id", "tag", (F.col("most") - F.col("n") + 1).alias("place"), (F.col("most") == F.col("n")).alias("latest"))


@query("SELECT author, repo_name, version AS cpe_version, list(tag ORDER BY pos, tag) AS git_tags, arg_min(tag, (pos, tag)) AS first_tag FROM (SELECT author, repo_name, version, tag, min(lv_id) AS pos FROM lib_version WHERE version IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def a19_tags_of_versions(spark: SparkSession, d: str) -> DataFrame:
    """The tags of each version in the order of the version map, and the first one."""
    return knowledge.tags_of_versions(knowledge.mapped_tags(table(spark, d, "lib_version")))


@query("SELECT unique_id, arg_max(name, (loaded_at, software_row)) AS name, arg_max(author, (loaded_at, software_row)) AS author FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY loaded_at DESC, software_row DESC) AS k FROM software) WHERE k = 1 AND op <> 'delete' GROUP BY 1")
def sk2_software_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The last delivered state of each software, without deleted ones (SK2)."""
    return knowledge.last_per_key(table(spark, d, "software"), "unique_id", "loaded_at", "software_row").where("op <> 'delete'").select("unique_id", "name", "author")


@query("SELECT DISTINCT src_id, dst_id, 'REUSES' AS rel FROM reuses WHERE src_id IS NOT NULL AND dst_id IS NOT NULL")
def sk3_merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges merged: each once (SK3)."""
    return table(spark, d, "reuses").where("src_id is not null and dst_id is not null").select("src_id", "dst_id", F.lit("REUSES").alias("rel")).distinct()


@query("SELECT author || '%' || repo_name AS src, unique_id AS dst, count(*) AS n FROM lib_version WHERE author IS NOT NULL GROUP BY 1, 2")
def sk4_created_edges(spark: SparkSession, d: str) -> DataFrame:
    """HAS_VERSION edges created, with their multiplicity kept (SK4)."""
    v = table(spark, d, "lib_version").where("author is not null")
    return v.groupBy(F.concat("author", F.lit("%"), "repo_name").alias("src"), F.col("unique_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cpe_key, arg_max(git_key, (pos, git_key)) AS git_key FROM git2cpe GROUP BY 1")
def sc12_name_map(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.name_map(table(spark, d, "git2cpe"))


_BOUND_NAMES = (("si", "versionStartIncluding"), ("se", "versionStartExcluding"), ("ei", "versionEndIncluding"), ("ee", "versionEndExcluding"))
_BOUNDS = [f"{column} AS {short}" for short, column in _BOUND_NAMES]


def _affects(spark: SparkSession, d: str) -> DataFrame:
    """Matches that count as vulnerable, with the repository of their product."""
    m = nested.configuration_matches(table(spark, d, "nvd_raw"), "raw_id", "doc").where("vulnerable")
    p = m.withColumn("p", N.parsed_cpe(F.col("cpe23uri"))).where("p.vendor is not null").withColumn("cpe_key", F.concat("p.vendor", F.lit("@@"), "p.product"))
    git = F.split(F.coalesce("git_key", "cpe_key"), "@@")
    return p.join(knowledge.name_map(table(spark, d, "git2cpe")), "cpe_key", "left").select("*", git[0].alias("author"), git[1].alias("repo_name"))


_MATCHED = """vm AS (SELECT *, regexp_extract(uri, '^cpe:2\\.3:([aho]):([^:]+):([^:]+):([^:]+)', 2) AS vendor, regexp_extract(uri, '^cpe:2\\.3:([aho]):([^:]+):([^:]+):([^:]+)', 3) AS product, regexp_extract(uri, '^cpe:2\\.3:([aho]):([^:]+):([^:]+):([^:]+)', 4) AS cpe_version
  FROM (SELECT raw_id, node_path, match_pos, m ->> '$.cpe23Uri' AS uri, m ->> '$.versionStartIncluding' AS si, m ->> '$.versionStartExcluding' AS se, m ->> '$.versionEndIncluding' AS ei, m ->> '$.versionEndExcluding' AS ee
        FROM hit WHERE m ->> '$.vulnerable' = 'true')
  WHERE regexp_matches(uri, '^cpe:2\\.3:([aho]):([^:]+):([^:]+):([^:]+)')),
aff AS (SELECT vm.*, split_part(coalesce(git_key, vendor || '@@' || product), '@@', 1) AS author, split_part(coalesce(git_key, vendor || '@@' || product), '@@', 2) AS repo_name
  FROM vm LEFT JOIN (SELECT cpe_key, arg_max(git_key, (pos, git_key)) AS git_key FROM git2cpe GROUP BY 1) g ON g.cpe_key = vendor || '@@' || product)"""


def _json_nodes() -> str:
    from cascadelens.plans.general_problems import _JSON_NODES

    return _JSON_NODES.rstrip() + ",\n"


@query(_json_nodes() + _MATCHED + " SELECT DISTINCT aff.raw_id, s.unique_id FROM aff JOIN software s ON s.name = aff.repo_name AND s.author = aff.author")
def j4_affects_software(spark: SparkSession, d: str) -> DataFrame:
    """AFFECTS edges to software."""
    s = table(spark, d, "software").select(F.col("name").alias("repo_name"), "author", "unique_id")
    return _affects(spark, d).select("raw_id", "author", "repo_name").join(s, ["author", "repo_name"]).select("raw_id", "unique_id").distinct()


_AFFECTED = "affects AS (SELECT DISTINCT j ->> '$.cve.CVE_data_meta.ID' AS cve_id, s.unique_id AS id FROM aff JOIN docs USING (raw_id) JOIN software s ON s.name = aff.repo_name AND s.author = aff.author WHERE j ->> '$.cve.CVE_data_meta.ID' IS NOT NULL)"


@query(
    _json_nodes()
    + _MATCHED
    + f""", {_AFFECTED}, links AS (SELECT DISTINCT src_id AS up, dst_id AS id FROM reuses WHERE src_id IS NOT NULL AND dst_id IS NOT NULL),
    reach AS (SELECT cve_id, id, 0 AS depth, [id] AS path FROM affects UNION ALL SELECT cve_id, up, depth + 1, list_append(path, up) FROM reach JOIN links USING (id) WHERE NOT list_contains(path, up))
    SELECT cve_id, id, CAST(min(depth) AS INT) AS depth, arg_min(path, (depth, path)) AS path FROM reach GROUP BY 1, 2"""
)
def g4_propagation(spark: SparkSession, d: str) -> DataFrame:
    """What each vulnerability reaches: affected software and all that reuses it, with the shortest path."""
    affects = j4_affects_software(spark, d).join(_records(spark, d).select("raw_id", "cve_id"), "raw_id").select("cve_id", F.col("unique_id").alias("id"))
    return graph.propagate(affects, table(spark, d, "reuses"), "src_id", "dst_id")


@query(
    _json_nodes()
    + _MATCHED
    + f""", named AS (SELECT DISTINCT raw_id, author, repo_name, cpe_version AS version FROM aff WHERE regexp_full_match(cpe_version, '\\d+(\\.\\d+){{0,2}}') AND coalesce(si, '') = '' AND coalesce(se, '') = '' AND coalesce(ei, '') = '' AND coalesce(ee, '') = ''),
    vmap AS (SELECT DISTINCT author, repo_name, version, tag FROM lib_version WHERE version IS NOT NULL), owner AS (SELECT repo_name, tag, arg_min(author, lv_id) AS author FROM lib_version GROUP BY 1, 2),
    ex AS (SELECT DISTINCT repo_name, tag, author, {_extract_version_sql("tag")} AS version FROM lib_version)
    SELECT DISTINCT raw_id, o.author, o.repo_name, o.tag, 'map' AS "by" FROM named n JOIN vmap m ON m.author = n.author AND m.repo_name = n.repo_name AND m.version = n.version JOIN owner o ON o.repo_name = m.repo_name AND o.tag = m.tag
    UNION SELECT DISTINCT raw_id, ex.author, ex.repo_name, ex.tag, 'extracted' FROM named n JOIN ex ON ex.repo_name = n.repo_name AND ex.version = n.version WHERE NOT EXISTS (SELECT 1 FROM vmap m WHERE m.author = n.author AND m.repo_name = n.repo_name AND m.version = n.version)"""
)
def j5_affects_exact(spark: SparkSession, d: str) -> DataFrame:
    """AFFECTS_VERSION edges of matches that name one version: by the version map, else by the extracted version."""
    a = _affects(spark, d).select("raw_id", "author", "repo_name", F.col("p.version").alias("version"), *map(F.expr, _BOUNDS))
    tags = table(spark, d, "lib_version")
    return knowledge.affected_exactly(a, tags, knowledge.mapped_tags(tags))


_RANGES = f"""{_MATCHED}, {_CHAIN}, vmap AS (SELECT author, repo_name, version AS cpe_version, arg_min(tag, (pos, tag)) AS tag FROM (SELECT author, repo_name, version, tag, min(lv_id) AS pos FROM lib_version WHERE version IS NOT NULL GROUP BY ALL) GROUP BY ALL),
place AS (SELECT v.author, v.repo_name, v.cpe_version, coalesce(t.ord, e.ord) AS ord FROM vmap v LEFT JOIN chain t ON t.author = v.author AND t.repo_name = v.repo_name AND t.tag = v.tag LEFT JOIN chain e ON e.author = v.author AND e.repo_name = v.repo_name AND e.version = {_extract_version_sql("v.tag")}),
b AS (SELECT DISTINCT raw_id || '/' || node_path || '/' || match_pos AS range_id, aff.author, aff.repo_name, coalesce(si <> '', false) AS si_in, coalesce(ei <> '', false) AS ei_in, coalesce(nullif(si, ''), nullif(se, '')) AS lo, coalesce(nullif(ei, ''), nullif(ee, '')) AS hi FROM aff),
r AS (SELECT range_id, b.author, b.repo_name, c.tag, c.ord, s1.author IS NOT NULL OR s2.author IS NOT NULL AS has_start, e1.author IS NOT NULL OR e2.author IS NOT NULL AS has_end,
  CASE WHEN s1.author IS NOT NULL THEN s1.ord ELSE s2.ord END AS st, CASE WHEN e1.author IS NOT NULL THEN e1.ord ELSE e2.ord END AS en, si_in, ei_in,
  (c.ord > st OR (c.ord = st AND si_in)) AS up, (c.ord < en OR (c.ord = en AND ei_in)) AS down FROM b JOIN chain c ON c.author = b.author AND c.repo_name = b.repo_name
  LEFT JOIN place s1 ON s1.author = b.author AND s1.repo_name = b.repo_name AND s1.cpe_version = lo LEFT JOIN place s2 ON s2.author = b.author AND s2.repo_name = b.repo_name AND s2.cpe_version = regexp_extract(lo, '^(\\d+\\.\\d+)', 1)
  LEFT JOIN place e1 ON e1.author = b.author AND e1.repo_name = b.repo_name AND e1.cpe_version = hi LEFT JOIN place e2 ON e2.author = b.author AND e2.repo_name = b.repo_name AND e2.cpe_version = regexp_extract(hi, '^(\\d+\\.\\d+)', 1)), ok AS (SELECT * FROM r WHERE has_start OR has_end)"""


def _ranges(spark: SparkSession, d: str, mode: str) -> DataFrame:
    a = _affects(spark, d)
    ranges = a.select(
        F.concat_ws("/", F.col("raw_id").cast("string"), "node_path", F.col("match_pos").cast("string")).alias("range_id"),
        "author",
        "repo_name",
        *map(F.expr, _BOUNDS),
    )
    tags = _dated(spark, d)
    return knowledge.affected_by_range(ranges, knowledge.version_chain(tags), mode, knowledge.mapped_tags(tags))


@query(_json_nodes() + _RANGES + " SELECT DISTINCT range_id, author, repo_name, tag FROM ok WHERE CASE WHEN NOT has_start THEN down WHEN st IS NULL THEN false WHEN en IS NULL OR en < st THEN up WHEN en = st THEN ord = st AND ei_in ELSE ord <= en AND up END")
def j7_affected_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions in the ranges of the matches, with the literal treatment of exclusive ends."""
    return _ranges(spark, d, "literal")


@query(_json_nodes() + _RANGES + " SELECT DISTINCT range_id, author, repo_name, tag FROM ok WHERE CASE WHEN NOT has_start THEN down WHEN st IS NULL THEN false WHEN en IS NULL THEN up WHEN en = st AND si_in AND ei_in THEN ord = st ELSE up AND down END")
def j8_affected_versions_intended(spark: SparkSession, d: str) -> DataFrame:
    """Versions in the ranges of the matches, as half-open intervals."""
    return _ranges(spark, d, "intended")


@query(
    f"""WITH dep AS ({_DEP}), v AS (SELECT DISTINCT unique_id AS lib_unique_id, author || '%' || repo_name AS lib_key, version FROM lib_version WHERE version IS NOT NULL)
    SELECT DISTINCT reuse_id, src_id, lib_unique_id FROM dep JOIN v ON dst_id = lib_key WHERE want <> '' AND CASE WHEN kind IS NOT NULL THEN starts_with(version, base || '.') OR version = base
      WHEN version_op = '>=' THEN version >= full_version WHEN version_op = '<=' THEN version <= full_version WHEN version_op = '>' THEN version > full_version WHEN version_op = '<' THEN version < full_version ELSE version = full_version END"""
)
def j9_version_reuse(spark: SparkSession, d: str) -> DataFrame:
    """VERSION_REUSE edges by version condition."""
    r = table(spark, d, "reuses").select("reuse_id", "src_id", "dst_id", "version_op", F.col("version").alias("want"))
    v = table(spark, d, "lib_version").select(F.col("unique_id").alias("lib_unique_id"), F.concat("author", F.lit("%"), "repo_name").alias("lib_key"), "version").distinct()
    return knowledge.version_reuse(r, v)


@query(
    """WITH p AS (SELECT DISTINCT lower(commit_id) AS commit_id, upper(trim(cve_id, ' ' || chr(9) || chr(10) || chr(13))) AS cve_id, repo_owner, repo_name, commit_version FROM patch WHERE commit_id IS NOT NULL)
    SELECT 'FIXES_CVE' AS rel, commit_id AS src, p.cve_id AS dst FROM p SEMI JOIN cve c ON c.cve_id = p.cve_id
    UNION SELECT 'FIX', commit_id, s.unique_id FROM p JOIN software s ON s.name = p.repo_name AND s.author = p.repo_owner
    UNION SELECT 'FIXES_VERSION', commit_id, l.unique_id FROM p JOIN lib_version l ON l.repo_name = p.repo_name AND l.tag = p.commit_version"""
)
def j10_patch_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from patches to vulnerabilities, software and versions."""
    p = table(spark, d, "patch").where("commit_id is not null").select(F.lower("commit_id").alias("src"), F.upper(F.regexp_replace("cve_id", r"^\s+|\s+$", "")).alias("cve_id"), "repo_owner", "repo_name", "commit_version").distinct()
    cves = table(spark, d, "cve").select("cve_id").distinct()
    soft = table(spark, d, "software").select(F.col("name").alias("repo_name"), F.col("author").alias("repo_owner"), F.col("unique_id").alias("dst")).distinct()
    vers = table(spark, d, "lib_version").select("repo_name", F.col("tag").alias("commit_version"), F.col("unique_id").alias("dst")).distinct()
    edge = lambda rel, df: df.select(F.lit(rel).alias("rel"), "src", "dst")
    return edge("FIXES_CVE", p.join(cves, "cve_id").withColumn("dst", F.col("cve_id"))).unionByName(edge("FIX", p.join(soft, ["repo_name", "repo_owner"]))).unionByName(edge("FIXES_VERSION", p.join(vers, ["repo_name", "commit_version"]))).distinct()


_REFS = """refs AS (SELECT raw_id, cve_id, CAST(i AS INT) AS pos, r ->> '$.url' AS url, r ->> '$.refsource' AS refsource, coalesce(CAST(json_extract(r, '$.tags') AS VARCHAR[]), []) AS tags FROM (
  SELECT raw_id, cve_id, i, json_extract(l, '$[' || i || ']') AS r FROM (SELECT raw_id, cve_id, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM (
    SELECT raw_id, j ->> '$.cve.CVE_data_meta.ID' AS cve_id, coalesce(CASE WHEN json_type(j, '$.cve.references.reference_data') = 'ARRAY' THEN json_extract(j, '$.cve.references.reference_data') END, CASE WHEN json_type(j, '$.references.reference_data') = 'ARRAY' THEN json_extract(j, '$.references.reference_data') END) AS l
    FROM (SELECT raw_id, CASE WHEN json_valid(doc) THEN json(doc) END AS j FROM nvd_raw)) WHERE l IS NOT NULL)) WHERE r ->> '$.url' IS NOT NULL)"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.references(table(spark, d, "nvd_raw"), "raw_id", "doc")


@query(f"WITH {_REFS} SELECT raw_id, pos, url, refsource, len(tags) AS n_tags, contains(url, 'commit') AS is_commit, len(tags) = 0 AS is_normal, list_contains(tags, 'Patch') AS is_patch FROM refs")
def j11_references(spark: SparkSession, d: str) -> DataFrame:
    """Reference nodes (F10, F11, F12, query2 to query4, query22)."""
    r = _references(spark, d)
    return r.select("raw_id", "pos", "url", "refsource", F.size("tags").cast("bigint").alias("n_tags"), F.contains("url", F.lit("commit")).alias("is_commit"), (F.size("tags") == 0).alias("is_normal"), F.array_contains("tags", "Patch").alias("is_patch"))


def _relation_sql() -> str:
    parts = []
    for rel, ref_first, tags in knowledge.REFERENCE_RELATIONS:
        holds = f"len(list_intersect(tags, [{', '.join(repr(t) for t in tags)}])) > 0" if tags else "len(tags) = 0"
        parts.append(f"SELECT '{rel}' AS rel, {'url, cve_id' if ref_first else 'cve_id, url'} FROM refs WHERE cve_id IS NOT NULL AND {holds}")
    return f"WITH {_REFS} SELECT rel, src, dst FROM (" + " UNION ".join(parts).replace("url, cve_id", "url AS src, cve_id AS dst", 1) + ")"


@query(_relation_sql())
def j11_reference_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relations between vulnerabilities and references (J11, query6 to query14, query61)."""
    return knowledge.reference_relations(_references(spark, d))


_BUGS = """bugs AS (SELECT raw_id, j ->> '$.cve.CVE_data_meta.ID' AS cve_id, j ->> '$.cve.description.description_data[0].value' AS description, j ->> '$.cve.problemtype.problemtype_data[0].description[0].value' AS problem_type,
  j ->> '$.impact.baseMetricV2.severity' AS severity, CAST(j ->> '$.impact.baseMetricV2.exploitabilityScore' AS DOUBLE) AS exploitability, CAST(j ->> '$.impact.baseMetricV2.impactScore' AS DOUBLE) AS impact,
  CAST(j ->> '$.impact.baseMetricV2.cvssV2.baseScore' AS DOUBLE) AS base_score, j ->> '$.impact.baseMetricV2.cvssV2.vectorString' AS vector, j ->> '$.configurations.nodes[0].operator' AS operator, left(j ->> '$.publishedDate', 10) AS published_day, left(j ->> '$.lastModifiedDate', 10) AS modified_day,
  CAST(date_diff('day', try_strptime(left(j ->> '$.publishedDate', 10), '%Y-%m-%d'), try_strptime(left(j ->> '$.lastModifiedDate', 10), '%Y-%m-%d')) AS INT) AS lasting
  FROM (SELECT raw_id, CASE WHEN json_valid(doc) THEN json(doc) END AS j FROM nvd_raw) WHERE j ->> '$.cve.CVE_data_meta.ID' IS NOT NULL)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.vulnerabilities(table(spark, d, "nvd_raw"), "raw_id", "doc")


@query(f"WITH {_BUGS} SELECT * FROM bugs")
def f23_vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerability nodes (F22, F23, X27, query1, LASTING)."""
    return _records(spark, d)


@query(_json_nodes() + "m AS (SELECT raw_id, node_path, match_pos, {'cpe23Uri': coalesce(m ->> '$.cpe23Uri', ''), 'versionStartIncluding': coalesce(m ->> '$.versionStartIncluding', ''), 'versionEndExcluding': coalesce(m ->> '$.versionEndExcluding', '')} AS p FROM hit WHERE m ->> '$.vulnerable' = 'true') SELECT raw_id, CAST(to_json(list(p ORDER BY node_path, match_pos)) AS VARCHAR) AS affected_cpes FROM m GROUP BY 1")
def x29_affected_cpes(spark: SparkSession, d: str) -> DataFrame:
    """The matches of a record that count, as one JSON text."""
    m = nested.configuration_matches(table(spark, d, "nvd_raw"), "raw_id", "doc").where("vulnerable")
    told = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    body = F.struct(told("cpe23uri", "cpe23Uri"), told("versionStartIncluding", "versionStartIncluding"), told("versionEndExcluding", "versionEndExcluding"))
    listed = m.groupBy("raw_id").agg(F.sort_array(F.collect_list(F.struct("node_path", "match_pos", body.alias("b")))).alias("l"))
    return listed.select("raw_id", F.to_json(F.transform("l", lambda x: x["b"])).alias("affected_cpes"))


@query(f"WITH {_BUGS} SELECT DISTINCT cve_id, problem_type FROM bugs WHERE problem_type IS NOT NULL")
def j13_problem_types(spark: SparkSession, d: str) -> DataFrame:
    """Problem types of vulnerabilities (J13, A21, F13, query15)."""
    return knowledge.vulnerabilities(table(spark, d, "nvd_raw"), "raw_id", "doc").where("problem_type is not null").select("cve_id", "problem_type").distinct()


@query(_json_nodes().rstrip().rstrip(",") + f", {_REFS} " + "SELECT DISTINCT cve_id, p[5] || p[6] AS name FROM (SELECT raw_id, string_split(m ->> '$.cpe23Uri', ':') AS p FROM hit WHERE node_path = '0') JOIN refs USING (raw_id) WHERE cve_id IS NOT NULL AND p[6] IS NOT NULL")
def j12_affected_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Edges from vulnerabilities to the libraries of their first node (J12, query7)."""
    m = nested.configuration_matches(table(spark, d, "nvd_raw"), "raw_id", "doc")
    return knowledge.library_edges(m, _references(spark, d))


@query(_json_nodes() + "lib AS (SELECT raw_id, string_split(m ->> '$.cpe23Uri', ':') AS p, coalesce(m ->> '$.vulnerable' = 'true', false) AS vulnerable FROM hit) SELECT p[5] || p[6] AS name, p[3] AS component_type, p[4] AS supplier, p[5] AS component, bool_or(vulnerable) AS vulnerable FROM lib WHERE p[6] IS NOT NULL GROUP BY ALL")
def j12_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Library nodes named product and version (J12, query5, X15)."""
    m = nested.configuration_matches(table(spark, d, "nvd_raw"), "raw_id", "doc")
    p = lambda i: N.cpe_part(F.col("cpe23uri"), i)
    lib = m.where(p(5).isNotNull()).select(F.concat(p(4), p(5)).alias("name"), p(2).alias("component_type"), p(3).alias("supplier"), p(4).alias("component"), "vulnerable")
    return lib.groupBy("name", "component_type", "supplier", "component").agg(F.bool_or("vulnerable").alias("vulnerable"))


@query(
    f"""WITH {_LIB_DATES}, t AS (SELECT author || '%' || repo_name AS repo, tag, readings[1] AS at, lv_id FROM lib_version JOIN inst ON row_id = lv_id WHERE author IS NOT NULL AND len(readings) > 0),
    c AS (SELECT commit_row, repo, epoch_us(commit_ts) AS at FROM commit_log WHERE op = 'upsert' AND commit_ts IS NOT NULL)
    SELECT commit_row, coalesce(arg_max(tag, (t.at, lv_id)) FILTER (WHERE t.at <= c.at), 'Unknown') AS tag, arg_min(tag, (t.at, lv_id)) FILTER (WHERE t.at >= c.at) AS first_containing, count(*) FILTER (WHERE t.at >= c.at) AS n_containing FROM c LEFT JOIN t USING (repo) GROUP BY 1"""
)
def sc21_nearest_tag(spark: SparkSession, d: str) -> DataFrame:
    """The last tag before each commit of its repository, the first that contains it and how many do (SC21, SC22)."""
    tags = _dated(spark, d).where("author is not null").select(F.concat("author", F.lit("%"), "repo_name").alias("repo"), "at", "tag", "lv_id")
    commits = table(spark, d, "commit_log").where("op = 'upsert' and commit_ts is not null").select("commit_row", "repo", F.unix_micros("commit_ts").alias("at"))
    return knowledge.nearest_tag(commits, tags)


@query(
    """WITH c AS (SELECT lower(trim(commit_id)) AS id, arg_max(commit_ts, (loaded_at, commit_row)) AS ts FROM commit_log WHERE op = 'upsert' AND commit_id IS NOT NULL AND commit_ts IS NOT NULL GROUP BY 1)
    SELECT patch_id, coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), 'Unknown') AS commit_time FROM patch p LEFT JOIN c ON c.id = lower(trim(p.commit_id))"""
)
def sc23_commit_times(spark: SparkSession, d: str) -> DataFrame:
    """When the commit of each patch was made, or Unknown (SC23)."""
    key = F.lower(F.trim("commit_id"))
    log = table(spark, d, "commit_log").where("op = 'upsert' and commit_id is not null and commit_ts is not null")
    made = log.groupBy(key.alias("id")).agg(F.max_by("commit_ts", F.struct("loaded_at", "commit_row")).alias("ts"))
    p = table(spark, d, "patch").select("patch_id", key.alias("id"))
    return p.join(made, "id", "left").select("patch_id", F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown")).alias("commit_time"))


# ---- preparation and set operations -------------------------------------------------------------------
@query("SELECT full_name, stars, row_number() OVER (ORDER BY stars DESC, pos, full_name) AS place FROM (SELECT full_name, arg_max(stars, pos) AS stars, max(pos) AS pos FROM (SELECT coalesce(author, 'None') || '/' || name AS full_name, software_row AS pos, length(unique_id) AS stars FROM software) GROUP BY 1)")
def a18_last_by_name(spark: SparkSession, d: str) -> DataFrame:
    """One row a full name, the last wins, and its place by stars (A18, T6, S4); lengths stand for stars."""
    s = table(spark, d, "software").select(F.concat(F.coalesce("author", F.lit("None")), F.lit("/"), "name").alias("full_name"), F.col("software_row").alias("pos"), F.length("unique_id").cast("bigint").alias("stars"))
    last = s.groupBy("full_name").agg(F.max_by("stars", "pos").alias("stars"), F.max("pos").alias("pos")).withColumn("less", -F.col("stars"))
    return along(last, [], ["less", "pos", "full_name"], ordinal="place").select("full_name", "stars", "place")


@query(
    """SELECT sbom_id, o.unique_id AS src_id, coalesce(f.unique_id, 'None%' || trim(depname)) AS dst_id, f.unique_id IS NOT NULL AS known, version, version_op FROM sbom_component
    JOIN (SELECT author || '@@' || name AS project, min(unique_id) AS unique_id FROM software WHERE author IS NOT NULL GROUP BY 1) o USING (project)
    LEFT JOIN (SELECT name, min(unique_id) AS unique_id FROM software WHERE name IS NOT NULL GROUP BY 1) f ON f.name = trim(depname) WHERE trim(depname) <> ''"""
)
def j19_component_edges(spark: SparkSession, d: str) -> DataFrame:
    """REUSES edges from projects to the components of their SBOM."""
    return knowledge.component_edges(table(spark, d, "sbom_component"), table(spark, d, "software"))


@query(r"SELECT author, repo_name, n_files, ratio, ratio >= 0.4 AS is_cpp FROM (SELECT author, repo_name, count(*) AS n_files, round(count(*) FILTER (WHERE regexp_matches(file_path, '\.(c|cpp|cc|cxx|h|hpp)$')) / count(*), 9) AS ratio FROM (SELECT DISTINCT author, repo_name, file_path FROM function_signature) GROUP BY 1, 2)")
def f17_cpp_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of C and C++ files of each repository."""
    f = _functions(spark, d).select("author", "repo_name", "file_path").distinct()
    share = F.count(F.when(N.is_library_file(F.col("file_path"), prune=False), 1)) / F.count(F.lit(1))
    r = f.groupBy("author", "repo_name").agg(F.count(F.lit(1)).alias("n_files"), F.round(share, 9).alias("ratio"))
    return r.withColumn("is_cpp", F.col("ratio") >= 0.4)


@query("SELECT unique_id AS repo FROM software EXCEPT SELECT coalesce(author, 'None') || '%' || repo_name FROM function_signature")
def j16_missing_repos(spark: SparkSession, d: str) -> DataFrame:
    """Software without functions."""
    have = _functions(spark, d).select(N.repo_key(F.col("author"), F.col("repo_name")).alias("repo"))
    return table(spark, d, "software").select(F.col("unique_id").alias("repo")).subtract(have)


@query("SELECT unique_id AS id FROM software UNION SELECT src_id FROM reuses WHERE src_id IS NOT NULL UNION SELECT dst_id FROM reuses WHERE dst_id IS NOT NULL")
def s3_all_ids(spark: SparkSession, d: str) -> DataFrame:
    """All ids of software and edges (S3)."""
    r = table(spark, d, "reuses")
    ids = table(spark, d, "software").select(F.col("unique_id").alias("id")).unionByName(r.select(F.col("src_id").alias("id"))).unionByName(r.select(F.col("dst_id").alias("id")))
    return ids.where("id is not null").distinct()


@query("SELECT patch_id, commit_id FROM (SELECT patch_id, commit_id, row_number() OVER (PARTITION BY repo_owner, repo_name, lower(commit_id) ORDER BY patch_id) AS k FROM patch WHERE commit_id IS NOT NULL) WHERE k = 1")
def f18_first_patches(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each commit of a repository (F18, SK9)."""
    p = table(spark, d, "patch").where("commit_id is not null")
    first = p.groupBy("repo_owner", "repo_name", F.lower("commit_id").alias("key")).agg(F.min(F.struct("patch_id", "commit_id")).alias("f"))
    return first.select("f.patch_id", "f.commit_id")


# ---- files written and read again ----------------------------------------------------------------------
@query("SELECT unique_id AS tpl, lower(arg_max(name, software_row)) AS tpl_name FROM software WHERE unique_id IS NOT NULL GROUP BY 1")
def sc6_library_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of libraries from a CSV file, the last one wins (SC5, SC6)."""
    path = scratch_path(spark, "names")
    table(spark, d, "software").where("unique_id is not null").orderBy("software_row").select("unique_id", "name").write.csv(path, header=True)
    return files.library_names(spark, path)


@query("SELECT DISTINCT author || '/' || repo_name AS name FROM lib_version WHERE author IS NOT NULL")
def sc15_line_set(spark: SparkSession, d: str) -> DataFrame:
    """A list written line by line and read as a set (SC15, SK8)."""
    path = scratch_path(spark, "list")
    sinks.write_list(table(spark, d, "lib_version").where("author is not null").select(F.concat("author", F.lit("%"), "repo_name").alias("k")), "k", path)
    return files.line_set(spark, path)


@query("SELECT lv_id, coalesce(CASE WHEN lv_id % 3 > 0 THEN commit_date END, strftime(loaded_at, '%Y-%m-%d')) AS commit_date FROM lib_version")
def sc18_tag_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date of a tag, else of its last commit (SC18)."""
    t = table(spark, d, "lib_version").select("lv_id", F.when(F.col("lv_id") % 3 > 0, F.col("commit_date")).alias("creator_date"), F.date_format("loaded_at", "yyyy-MM-dd").alias("last_commit_date"))
    return files.tag_dates(t).select("lv_id", "commit_date")


@query("SELECT tag, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS tag_time FROM lib_version WHERE tag <> '' AND NOT contains(tag, ',') AND NOT contains(tag, ')')")
def sc20_tag_times(spark: SparkSession, d: str) -> DataFrame:
    """Tags and times of decorated log lines (SC20, X31)."""
    line = F.concat(F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000  (HEAD -> main, tag: "), "tag", F.lit(", origin/main)"))
    return files.tag_log(table(spark, d, "lib_version").where("tag <> '' and not contains(tag, ',') and not contains(tag, ')')").select(line.alias("value"))).select("tag", "tag_time")


@query("SELECT patch_id, cve_id, repo_name FROM patch")
def sk1_json_results(spark: SparkSession, d: str) -> DataFrame:
    """Results written as JSON and read again (SK1)."""
    path = scratch_path(spark, "json")
    sinks.write_json(table(spark, d, "patch").select("patch_id", "cve_id", "repo_name"), path)
    return spark.read.schema("patch_id bigint, cve_id string, repo_name string").json(path)


@query(f"WITH {_EDGES} SELECT s AS origin_tpl_uuid, x AS reuse_tpl_uuid FROM kept")
def sk6_edge_file(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies written as an edge list and read again (SK6, SC5)."""
    path = scratch_path(spark, "edges")
    sinks.write_edges(_dependencies(spark, d), path)
    return files.csv_table(spark, path, "origin_tpl_uuid string, reuse_tpl_uuid string")


@query("SELECT collector, patch_id FROM patch WHERE collector IS NOT NULL")
def sk7_tables_by_key(spark: SparkSession, d: str) -> DataFrame:
    """A table in a folder a key (SK5, SK7, SC25)."""
    path = scratch_path(spark, "keyed")
    sinks.write_by_key(table(spark, d, "patch").where("collector is not null").select("collector", "patch_id"), "collector", path)
    return spark.read.schema("patch_id bigint, collector string").parquet(path).select("collector", "patch_id")


@query("SELECT unique_id FROM software SEMI JOIN reuses ON unique_id = src_id WHERE unique_id NOT IN (SELECT dst_id FROM reuses WHERE dst_id IS NOT NULL)")
def sk9_not_done(spark: SparkSession, d: str) -> DataFrame:
    """Work that isn't in the table of finished work (SK9)."""
    r = table(spark, d, "reuses")
    work = table(spark, d, "software").select("unique_id").join(r.select(F.col("src_id").alias("unique_id")), "unique_id", "left_semi")
    return sinks.not_done(work, r.select(F.col("dst_id").alias("unique_id")).where("unique_id is not null"), "unique_id")
