"""Queries of the operators over the driver's tables, each with the DuckDB SQL that says the same.

The tables stand in for the operators' own inputs by role; every query's docstring names the roles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import compare, profiles, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive entries: archive = source, extension from lang, toxic = marked."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    marked = docs.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("bytes")).join(labels.select("doc_id", "toxic"), "doc_id", "left")
    segments = F.array(F.struct((F.col("n_chars") % 2 == 0).alias("is_compressed"), F.lit(0).cast("long").alias("offset"), F.col("n_chars").alias("unpacked_size"), F.col("bytes").alias("packed_size")))
    return marked.select(F.col("source").alias("archive"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("name"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_marked_encrypted"), F.col("n_chars").alias("unpacked_size"), F.col("bytes").alias("packed_size"), F.col("toxic").alias("adler32"), segments.alias("segments"))


_ENTRIES = "SELECT source AS archive, lang, coalesce(toxic = 1, false) AS marked, n_chars, strlen(text) AS bytes, toxic FROM documents LEFT JOIN labels USING (doc_id)"


@query(f"""SELECT archive, count(*) AS entry_count, count(*) FILTER (marked) AS encrypted_count, count(*) FILTER (NOT marked) AS plain_count,
 CAST(0 AS BIGINT) AS multi_segment_count, count(*) FILTER (n_chars % 2 = 0) AS compressed_segment_count, count(toxic) AS with_adler_count,
 CAST(sum(bytes) AS BIGINT) AS packed_bytes, CAST(sum(n_chars) AS BIGINT) AS unpacked_bytes FROM ({_ENTRIES}) GROUP BY archive""")
def archive_profile(spark, sf_dir):
    """A-01, A-03: documents as entries."""
    return profiles.archive_profile(_entries(spark, sf_dir))


@query(f"""SELECT archive, '.' || lang AS extension, count(*) AS entry_count, count(*) FILTER (marked) AS encrypted_count,
 CAST(sum(bytes) AS BIGINT) AS packed_bytes, CAST(sum(n_chars) AS BIGINT) AS unpacked_bytes FROM ({_ENTRIES}) GROUP BY archive, lang""")
def extension_profile(spark, sf_dir):
    """A-02, P-03: documents as entries."""
    return profiles.extension_profile(_entries(spark, sf_dir))


_URL_EXT = "lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1))"
_URL_CATEGORY = f"CASE WHEN {_URL_EXT} IN ('.png','.jpg','.jpeg','.bmp','.tlg','.tlg5','.tlg6','.psb','.pimg','.mdf','.mzs') THEN 'Images' WHEN {_URL_EXT} IN ('.ogg','.wav','.mp3','.amv','.mpg') THEN 'Audio' WHEN {_URL_EXT} IN ('.tjs','.ks','.kag','.scn','.txt') THEN 'Scripts' ELSE 'Other' END"


@query(f"SELECT {_URL_CATEGORY} AS category, count(*) AS entry_count FROM pages GROUP BY 1")
def category_rollup(spark, sf_dir):
    """P-01, A-15: page addresses as names."""
    return profiles.category_rollup(read(spark, sf_dir, "pages"), "url")


@query(f"SELECT page_id, {_URL_CATEGORY} AS category FROM pages WHERE {_URL_CATEGORY} = 'Other'")
def category_filter(spark, sf_dir):
    """P-02: page addresses as names."""
    pages = read(spark, sf_dir, "pages")
    return pages.where(X.matches_category(F.col("url"), "Other")).select("page_id", X.category(F.col("url")).alias("category"))


@query(f"SELECT coalesce(nullif({_URL_EXT}, ''), '(none)') AS extension, count(*) AS n FROM pages GROUP BY 1")
def extension_projection(spark, sf_dir):
    """P-03."""
    return read(spark, sf_dir, "pages").groupBy(X.extension_or_none(F.col("url")).alias("extension")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, CASE WHEN starts_with(html, 'BM') THEN 'Bmp' WHEN starts_with(html, 'OggS') THEN 'Ogg' WHEN starts_with(html, 'TLG') THEN 'Tlg' ELSE 'Unknown' END AS detected_format FROM pages
 UNION ALL SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Png' WHEN 1 THEN 'Jpeg' WHEN 2 THEN 'Wave' ELSE 'Unknown' END FROM pages""")
def format_sniff(spark, sf_dir):
    """P-09: pages as they are, and headers made from the page number."""
    pages = read(spark, sf_dir, "pages")
    made = F.when(F.col("page_id") % 4 == 0, "89504E470D0A1A0A00").when(F.col("page_id") % 4 == 1, "FFD8FFE0").when(F.col("page_id") % 4 == 2, "524946460000000057415645").otherwise("524946460000000041564920")
    own = pages.select("page_id", X.sniff(F.encode("html", "UTF-8")).alias("detected_format"))
    return own.unionByName(pages.select("page_id", X.sniff(F.unhex(made)).alias("detected_format")))


_PATH = "regexp_replace(url, '^https?://', '')"


@query(f"""SELECT page_id, trim({_PATH}) <> '' AND NOT contains({_PATH}, '\\') AND NOT regexp_matches({_PATH}, '^([A-Za-z]:|/)')
 AND len(list_filter(string_split({_PATH}, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe FROM pages""")
def package_path(spark, sf_dir):
    """P-05: page addresses without scheme as package paths."""
    path = F.regexp_replace("url", "^https?://", "")
    return read(spark, sf_dir, "pages").select("page_id", X.safe_relative_path(path).alias("safe"))


@query("""SELECT page_id, page_id % 3 <> 2 AS contained FROM pages""")
def path_containment(spark, sf_dir):
    """P-06: paths made from the page number; every third climbs out."""
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.lit("a/../b/./c")).otherwise(F.lit("a/../../b"))
    return read(spark, sf_dir, "pages").select("page_id", X.contained(made).alias("contained"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 8 AND lower(event_type) IN ('click', 'view', 'error')")
def file_access_filter(spark, sf_dir):
    """P-12: events as file accesses (process = user, operation = type)."""
    events = read(spark, sf_dir, "events")
    return events.where((F.col("user_id") == 8) & F.lower("event_type").isin("click", "view", "error")).select("event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_type, event_id % 2 AS side FROM events),
 l AS (SELECT user_id, event_type, count(*) AS left_count FROM e WHERE side = 0 GROUP BY ALL), r AS (SELECT user_id, event_type, count(*) AS right_count FROM e WHERE side = 1 GROUP BY ALL)
 SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.event_type, r.event_type) AS event_type, coalesce(left_count, 0) AS left_count, coalesce(right_count, 0) AS right_count
 FROM l FULL JOIN r ON l.user_id IS NOT DISTINCT FROM r.user_id AND l.event_type IS NOT DISTINCT FROM r.event_type WHERE coalesce(left_count, 0) <> coalesce(right_count, 0)""")
def file_access_count_diff(spark, sf_dir):
    """J-06, A-05, U-02: even and odd events as two recordings."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return compare.count_difference(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"])


def _overlay(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    side = lambda rows, t: rows.select("doc_id", (F.col("doc_id") % 14 == 4).alias("is_dir"), F.octet_length(t).cast("long").alias("length"), F.sha2(t, 256).alias("sha256"))
    override = side(docs.where("doc_id % 3 <> 0"), text).withColumn("is_dir", F.lit(False))
    return compare.overlay(side(docs.where("doc_id % 2 = 0"), F.col("text")), override, "doc_id")


_OVERLAY = """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT doc_id, text AS t FROM documents WHERE doc_id % 2 = 0),
 p AS (SELECT o.doc_id, CASE WHEN r.doc_id IS NULL THEN 'Added' WHEN r.doc_id % 14 = 4 THEN 'Conflict' WHEN o.t = r.t THEN 'Identical' ELSE 'Replaced' END AS change_kind,
 strlen(o.t) AS override_length, sha256(o.t) AS override_sha256, strlen(r.t) AS reference_length, sha256(r.t) AS reference_sha256 FROM o LEFT JOIN r USING (doc_id))"""


@query(f"{_OVERLAY} SELECT * FROM p")
def overlay_plan(spark, sf_dir):
    """J-04, F-04: even documents as reference, two thirds of all as override."""
    return _overlay(spark, sf_dir)


@query(f"{_OVERLAY} SELECT change_kind, count(*) AS n FROM p GROUP BY 1")
def overlay_counts(spark, sf_dir):
    """A-15."""
    return _overlay(spark, sf_dir).groupBy("change_kind").agg(F.count("*").alias("n"))


@query("""SELECT 'Customer#' || k AS key, kind AS change_kind FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS k,
 CASE WHEN c_custkey % 7 = 0 THEN 'Added' WHEN c_custkey % 11 = 0 THEN 'Removed' WHEN c_custkey % 5 = 0 OR c_custkey % 13 = 0 THEN 'Changed' END AS kind FROM customer) WHERE kind IS NOT NULL""")
def report_compare(spark, sf_dir):
    """J-05: customers as scanned files, in two variants."""
    c = read(spark, sf_dir, "customer")
    left = c.where("c_custkey % 7 <> 0").select("c_name", F.sha2("c_name", 256).alias("digest"), F.array("c_mktsegment").alias("candidates"))
    digest = F.when(F.col("c_custkey") % 5 == 0, F.sha2(F.concat("c_name", F.lit("x")), 256)).otherwise(F.upper(F.sha2("c_name", 256)))
    candidates = F.when(F.col("c_custkey") % 13 == 0, F.array()).otherwise(F.array("c_mktsegment"))
    right = c.where("c_custkey % 7 = 0 OR c_custkey % 11 <> 0").select(F.col("c_name"), digest.alias("digest"), candidates.alias("candidates"))
    return compare.report_difference(left, right, "c_name", "digest", "candidates")


@query("""WITH a AS (SELECT DISTINCT upper(p_brand || p_type) AS value FROM part WHERE p_size < 10 AND p_brand || p_type IS NOT NULL), b AS (SELECT DISTINCT upper(p_brand || p_type) AS value FROM part WHERE p_size >= 40 AND p_brand || p_type IS NOT NULL)
 SELECT value, 'Removed' AS change_kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT value, 'Added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_diff_tagged(spark, sf_dir):
    """U-01: brands and types of small and of large parts as import sets."""
    part = read(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("v"), "p_size")
    return compare.set_difference(part.where("p_size < 10"), part.where("p_size >= 40"), "v")


@query("""SELECT c_custkey, 'c_name' AS field, c_name AS left_value, s_name AS right_value FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE lower(c_name) IS DISTINCT FROM lower(s_name)
 UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey""")
def value_diff(spark, sf_dir):
    """U-05: a customer and the supplier of its number as two reports."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    pairs = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", "c_name", "s_name", "c_nationkey", "s_nationkey")
    return compare.value_difference(pairs, "c_custkey", [("c_name", "s_name"), ("c_nationkey", "s_nationkey")])


@query("""WITH l AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 3 = 0), r AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 3 <> 0)
 SELECT *, 'Removed' AS change_kind FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'Added' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def finding_presence_diff(spark, sf_dir):
    """J-07: event types of users as findings."""
    e = read(spark, sf_dir, "events")
    return compare.presence_difference(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), ["event_type", "user_id"])


@query("""SELECT o_orderkey, coalesce(c.c_name, n.n_name, o_orderpriority) AS mapped_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON o_custkey % 25 = n_nationkey""")
def name_mapping(spark, sf_dir):
    """J-01: orders as entries, customers as exact names, nations as fallback."""
    o = read(spark, sf_dir, "orders").withColumn("alt", (F.col("o_custkey") % 25).cast("int"))
    exact = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_name")
    fallback = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    return rules.name_mapping(o, exact, fallback, "o_custkey", "alt", "o_orderpriority").select("o_orderkey", "mapped_name")


SCHEMES = [
    {"id": "license-a", "strings": ["licensed under", "apache"]},
    {"id": "token", "strings": ["Password="], "machine": "en"},
    {"id": "words", "strings": ["the "], "imports": ["SRC3"], "facts": ["short"]},
]


def _binaries(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("machine"), "text", F.array("source").alias("imports"), F.when(F.col("n_chars") < 2000, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("facts"), "source")


_MATCH = """SELECT doc_id AS id, 'license-a' AS scheme_id, 1 AS revision, 30 AS score FROM documents WHERE contains(upper(text), 'LICENSED UNDER') AND contains(upper(text), 'APACHE')
 UNION ALL SELECT doc_id, 'token', 1, 30 FROM documents WHERE lower(lang) = 'en' AND contains(upper(text), 'PASSWORD=')
 UNION ALL SELECT doc_id, 'words', 1, 45 FROM documents WHERE contains(upper(text), 'THE ') AND lower(source) = 'src3' AND n_chars < 2000"""


@query(_MATCH)
def fingerprint_match(spark, sf_dir):
    """J-02, A-11, F-14, O-02: documents as binaries."""
    return rules.fingerprint_match(_binaries(spark, sf_dir), SCHEMES)


@query("""SELECT doc_id, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 45 THEN 'medium' ELSE 'weak' END AS confidence FROM (SELECT doc_id, CAST(least(100, CASE WHEN contains(upper(text), 'LICENSED') THEN 70 ELSE 0 END + CASE WHEN contains(upper(text), 'PASSWORD') THEN 60 ELSE 0 END
 + CASE WHEN contains(upper(text), 'TOKEN') THEN 15 ELSE 0 END + least(n_chars // 1000 * 10, 30)) AS INTEGER) AS score FROM documents) WHERE score > 0""")
def heuristic_score(spark, sf_dir):
    """A-12: marks in documents, thousands of characters as constants."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return rules.heuristic_score(docs, "text", [("licensed", 70), ("password", 60), ("token", 15)], F.floor(F.col("n_chars") / 1000)).select("doc_id", "score", "confidence")


@query(f"""SELECT source, CASE count(DISTINCT scheme_id) WHEN 0 THEN 'NoMatch' WHEN 1 THEN 'Selected' ELSE 'Ambiguous' END AS status, CASE count(DISTINCT scheme_id) WHEN 1 THEN min(scheme_id) END AS selected
 FROM documents LEFT JOIN ({_MATCH}) m ON doc_id = m.id GROUP BY source""")
def compatibility_resolve(spark, sf_dir):
    """A-07, J-08, V-05: sources by the schemes of their documents."""
    b = _binaries(spark, sf_dir)
    found = rules.fingerprint_match(b, SCHEMES).select("id", "scheme_id")
    return rules.resolve(b.select("id", "source").join(found, "id", "left"), "source", "scheme_id")


@query("""WITH m AS (SELECT upper(s_name) AS k, min(s_name) AS path FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
 SELECT l_orderkey AS source, 'supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS module, path AS resolved_path FROM lineitem LEFT JOIN m ON upper('supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) = k""")
def relationship_resolve(spark, sf_dir):
    """J-03, A-06: line items as imports of suppliers."""
    imports = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.concat(F.lit("supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("module"))
    modules = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("file_name"), F.col("s_name").alias("path"))
    return rules.relationships(imports, modules)


@query("""SELECT doc_id, CASE WHEN nth = 1 THEN lang || '.txt' ELSE lang || '__duplicate-' || lpad(CAST(nth AS VARCHAR), CAST(greatest(3, length(CAST(nth AS VARCHAR))) AS INTEGER), '0') || '.txt' END AS output_name
 FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS nth FROM documents)""")
def dup_path_naming(spark, sf_dir):
    """W-01, fast path: documents of a source and language as entries of one name."""
    entries = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", F.lit(".txt")).alias("name"))
    return rules.duplicate_names(entries, ["source"], "name", ["doc_id"]).select("doc_id", "output_name")


@query("""SELECT user_id, event_id, CASE WHEN nth > 32 THEN event_type || '_CAPPED' ELSE event_type END AS code FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY event_id) AS nth FROM events) WHERE nth <= 33""")
def diagnostic_cap(spark, sf_dir):
    """W-02: events as diagnostics of five files."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("user_id") % 5).alias("file"), F.col("event_type").alias("code"))
    return rules.capped(e, ["file"], ["event_id"], "code").select("user_id", "event_id", "code")


@query("SELECT event_id, event_type AS code FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events) WHERE nth <= 32")
def row_cap(spark, sf_dir):
    """W-05, O-06: at most 32 a code, silently."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code"), F.lit(0).alias("file"))
    return rules.capped(e, ["file"], ["event_id"], "code", marker=False).select("event_id", "code")


@query("""SELECT o_custkey, o_orderkey, items, running, CASE WHEN items > 12 THEN 'items' WHEN cents > 40000000 THEN 'item' WHEN running > 200000000 THEN 'total' END AS broken FROM (SELECT *, count(*) OVER w AS items, CAST(sum(cents) OVER w AS BIGINT) AS running FROM
 (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))""")
def running_budget(spark, sf_dir):
    """W-03, A-08: orders of a customer as files of a package, cents as bytes."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return profiles.budget(o, ["o_custkey"], ["o_orderkey"], "cents", 12, 40_000_000, 200_000_000).select("o_custkey", "o_orderkey", "items", "running", "broken")


@query("""SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")
def segment_offsets(spark, sf_dir):
    """W-06: line items as segments of an order, quantity as size; equal line numbers by part, supplier and quantity."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return profiles.logical_offsets(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "q"], "q").select("l_orderkey", "l_linenumber", "logical_offset")


@query("""WITH c AS (SELECT a.conv_id, a.turn, regexp_extract_all(hex(encode(a.text)), '..') AS x, regexp_extract_all(hex(encode(b.text)), '..') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
 p AS (SELECT conv_id, turn, i, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM (SELECT conv_id, turn, unnest(range(greatest(len(x), len(y)))) AS i, unnest(x) AS u, unnest(y) AS v FROM c) WHERE u IS DISTINCT FROM v)
 SELECT conv_id, turn, min(i) AS start, count(*) AS length FROM p GROUP BY conv_id, turn, g""")
def byte_islands(spark, sf_dir):
    """W-04: whole texts of consecutive turns as two outputs of a filter."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return compare.byte_islands(c.join(after, ["conv_id", "turn"]), ["conv_id", "turn"], F.col("text"), F.col("next"))


_OUT = "c_mktsegment || CAST(c_custkey % 400 AS VARCHAR) || '.png'"


@query(f"""SELECT c_custkey, count(*) OVER (PARTITION BY upper({_OUT})) > 1 AS collides FROM customer""")
def collision_split(spark, sf_dir):
    """A-09, J-11: output paths made of segment and number."""
    path = F.concat("c_mktsegment", (F.col("c_custkey") % 400).cast("string"), F.lit(".png"))
    bad, good = compare.collisions(read(spark, sf_dir, "customer"), path)
    return bad.select("c_custkey", F.lit(True).alias("collides")).unionByName(good.select("c_custkey", F.lit(False).alias("collides")))


@query(f"SELECT CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM customer GROUP BY upper({_OUT}))")
def duplicate_surplus(spark, sf_dir):
    """A-10."""
    return profiles.duplicate_surplus(read(spark, sf_dir, "customer"), F.upper(F.concat("c_mktsegment", (F.col("c_custkey") % 400).cast("string"), F.lit(".png"))))


@query("""SELECT l_orderkey, scheme_id, score, accepted, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY accepted DESC, score DESC, scheme_id) AS INTEGER) AS place FROM
 (SELECT DISTINCT l_orderkey, lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS scheme_id, CAST(l_quantity AS INTEGER) AS score, l_returnflag = 'A' AS accepted FROM lineitem)) WHERE place <= 3""")
def candidate_rank(spark, sf_dir):
    """O-01: line items as candidates for an order."""
    scheme = F.concat_ws("-", F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", scheme.alias("scheme_id"), F.col("l_quantity").cast("int").alias("score"), (F.col("l_returnflag") == "A").alias("accepted")).distinct()
    return rules.rank_candidates(rows, ["l_orderkey"], 3)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth = 1")
def top_launcher(spark, sf_dir):
    """O-03, A-06: the longest document of each source."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return compare.first_per_key(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id")


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS length FROM documents")
def content_digests(spark, sf_dir):
    """F-04, F-12."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("length"))


@query("""WITH n AS (SELECT c_custkey, lower(c_name) AS s FROM customer) SELECT c_custkey, md5(unhex(list_aggregate(list_transform(range(1, length(s) + 1), lambda i: printf('%02X00', ascii(s[i]))), 'string_agg', ''))) AS alias FROM n""")
def md5_alias(spark, sf_dir):
    """F-05: ASCII names of customers."""
    return read(spark, sf_dir, "customer").select("c_custkey", X.md5_alias(F.col("c_name")).alias("alias"))


@query("""WITH b AS (SELECT item_id, hex(encode(text)) AS h, strlen(text) AS n FROM benchmark), c AS (SELECT item_id, n, i, CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM b))
 SELECT item_id, CAST(((n + sum((n - i + 1) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521 AS BIGINT) AS adler32 FROM c GROUP BY item_id, n""")
def adler32(spark, sf_dir):
    """F-02."""
    return read(spark, sf_dir, "benchmark").select("item_id", X.adler32(F.encode("text", "UTF-8")).alias("adler32"))


@query("""WITH c AS (SELECT item_id, b, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM benchmark) GROUP BY ALL) SELECT item_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY item_id""")
def entropy(spark, sf_dir):
    """A-13."""
    return profiles.entropy(read(spark, sf_dir, "benchmark"), "item_id", "text")


@query("SELECT item_id, len(regexp_extract_all(text, '[\\x20-\\x7E]{4,}')) AS n_runs, list_aggregate(list_transform(regexp_extract_all(text, '[\\x20-\\x7E]{4,}'), lambda r: length(r)), 'max') AS longest FROM benchmark")
def printable_runs(spark, sf_dir):
    """F-06."""
    runs = X.printable_runs(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(runs).cast("long").alias("n_runs"), F.array_max(F.transform(runs, lambda r: F.length(r).cast("long"))).alias("longest"))


@query("""SELECT 'unique orders' AS constraint_name, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unique line numbers', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'order of line item', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'customer of order', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
 UNION ALL SELECT 'form of brand', count(*) FROM part WHERE NOT coalesce(regexp_matches(p_brand, '^Brand#[0-9]$'), false)""")
def constraint_report(spark, sf_dir):
    """P-17, J-10: keys, references and forms of the star schema."""
    t = lambda n: read(spark, sf_dir, n)
    out = rules.unique_violations(t("orders"), ["o_orderkey"], "unique orders")
    for other in (rules.unique_violations(t("lineitem"), ["l_orderkey", "l_linenumber"], "unique line numbers"), rules.reference_violations(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "order of line item"), rules.reference_violations(t("orders"), "o_custkey", t("customer"), "c_custkey", "customer of order"), rules.pattern_violations(t("part"), "p_brand", r"^Brand#[0-9]$", "form of brand")):
        out = out.unionByName(other)
    return out


@query("""SELECT o_orderkey, CASE WHEN p IS NULL THEN 'NoSegments' WHEN p <> want THEN 'PackedMismatch' WHEN u <> want * 2 THEN 'UnpackedMismatch' ELSE 'Ok' END AS status FROM (SELECT o_orderkey, o_orderkey % 100 + 1 AS want FROM orders) LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS p, sum(CAST(l_quantity AS BIGINT) * 2) AS u FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def segment_reconcile(spark, sf_dir):
    """P-07, P-08, J-09: orders as entries, line items as segments."""
    entries = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 + 1).alias("want")).withColumn("twice", F.col("want") * 2)
    q = F.col("l_quantity").cast("long")
    segments = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), q.alias("packed_size"), (q * 2).alias("unpacked_size"))
    return rules.layout_problems(entries, segments, "o_orderkey", "want", "twice").select("o_orderkey", "status")


@query("SELECT page_id, url, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS removed FROM pages")
def redact_project(spark, sf_dir):
    """P-13: pages without their text, links counted."""
    return read(spark, sf_dir, "pages").select("page_id", "url", F.size(F.regexp_extract_all("html", F.lit("(<a )"), F.lit(1))).cast("long").alias("removed"))


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS "view", max(CASE WHEN event_type = 'error' THEN value END) AS error FROM events GROUP BY user_id""")
def pivot_manifest(spark, sf_dir):
    """J-12, V-13: events as captured tags of a user."""
    return rules.manifest(read(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["click", "view", "error"])


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS attempted, count(*) FILTER (toxic = 0) AS validated, count(*) FILTER (doc_id % 4 <> 0) AS recognised, count(*) FILTER (doc_id % 4 = 1 AND doc_id % 3 <> 0 AND doc_id % 3 <> 1 OR doc_id % 4 = 2 AND doc_id % 3 = 1) AS mismatched FROM labels""")
def task_rollup(spark, sf_dir):
    """A-04, P-14, P-15, P-16: labels as validations; formats and categories from the number."""
    fmt = F.when(F.col("doc_id") % 4 == 0, "Unknown").when(F.col("doc_id") % 4 == 1, "Png").when(F.col("doc_id") % 4 == 2, "Ogg").otherwise("MpegProgramStream")
    path = F.when(F.col("doc_id") % 3 == 0, "Other").when(F.col("doc_id") % 3 == 1, "Images").otherwise("Audio")
    rows = read(spark, sf_dir, "labels").select(fmt.alias("detected_format"), path.alias("path_category"), (F.col("quality") == 1).alias("attempted"), (F.col("toxic") == 0).alias("validated"))
    return profiles.rollup(rows.withColumn("detected_category", X.format_category(F.col("detected_format"))))


@query("""SELECT candidate, count(*) FILTER (ok) AS proofs, count(*) FILTER (ok) >= 3 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY o_orderkey) AS nth FROM (SELECT o_custkey % 50 AS candidate, o_orderkey, o_orderstatus = 'F' AS ok, o_totalprice FROM orders)) WHERE nth <= 8 AND o_totalprice <= 300000 GROUP BY candidate""")
def proof_count(spark, sf_dir):
    """A-16, O-09: orders as test entries of fifty candidates."""
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("candidate"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("ok"), "o_totalprice")
    return profiles.proofs(rows, "candidate", "o_orderkey", "ok", "o_totalprice", 8, 300_000, 3)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'x86' WHEN 1 THEN 'x64' WHEN 2 THEN 'ARM64' WHEN 3 THEN 'unknown-0x1234' ELSE 'ARM' END AS machine, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN 255 END AS parsed, 'dir/' || CAST(p_partkey AS VARCHAR) || '.png' AS output_path,
 printf('%06d-%06d-', CAST(p_partkey AS INTEGER), CAST(p_size AS INTEGER)) || replace(p_name, ' ', '_') AS file_name, CAST(p_partkey % 8 >= 6 AS BOOLEAN) AS accepted FROM part""")
def scalar_functions(spark, sf_dir):
    """F-09, F-11, F-13, F-15, P-10: values made from the part number."""
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, 0x014C).when(k % 5 == 1, 0x8664).when(k % 5 == 2, 0xAA64).when(k % 5 == 3, 0x1234).otherwise(0x01C0)
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "0xFF").otherwise("-1")
    path = F.concat(F.lit("dir/"), k.cast("string"), F.lit(".tlg"))
    return read(spark, sf_dir, "part").select("p_partkey", X.machine_name(code).alias("machine"), X.uint32(text).alias("parsed"), X.change_extension(path, ".png").alias("output_path"), X.safe_file_name(F.replace("p_name", F.lit(" "), F.lit("/")), k, F.col("p_size")).alias("file_name"), X.accepted(k % 8).alias("accepted"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def typed_fields(spark, sf_dir):
    """F-17: typed fields of JSON text."""
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT n_name AS name, row_number() OVER (ORDER BY upper(n_name), n_name) AS place FROM nation")
def ignore_case_order(spark, sf_dir):
    """O-04, O-05: names in the order of their upper-case form (25 rows)."""
    from pyspark.sql import Window

    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.row_number().over(Window.orderBy(F.upper("n_name"), "n_name")).cast("long").alias("place"))


@query("""SELECT lang, quality, count(*) AS entry_count, grouping_id(lang, quality) AS level FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality)""")
def cube_profile(spark, sf_dir):
    """Extension, not of the inventory: a profile over all subsets of two keys."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.cube("lang", "quality").agg(F.count("*").alias("entry_count"), F.grouping_id().cast("long").alias("level"))
