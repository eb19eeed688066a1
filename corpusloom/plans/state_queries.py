"""Queries of checks, audits and lifecycle on the shared tables.

Stand-ins: orders are metadata (path = order key) and line items its stored chunks, with some of either taken away by
remainders so that every detector finds something; documents and labels are files and their metadata; events are changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..operators import audit, checks, lifecycle
from .registry import Tables, query

# ---- checks

DOCS = "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS reviewed, CASE o_orderkey % 5 WHEN 0 THEN 'prototype' WHEN 1 THEN 'archived' ELSE 'active' END AS status, o_orderkey % 11 = 0 AS bare FROM orders"


def docs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "prototype").when(k % 5 == 1, "archived").otherwise("active")
    found = F.struct(F.array().cast("array<string>").alias("related"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_reviewed"), status.alias("status"), k.cast("string").alias("id"))
    return t.orders.select(k.cast("string").alias("path"), F.when(k % 11 != 0, found).alias("frontmatter"))


def doc_key(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc").cast("long").alias("id"))


TODAY = "1998-01-01"


@query(f"SELECT id FROM ({DOCS}) WHERE NOT bare AND status = 'active' AND date_diff('day', reviewed::DATE, DATE '{TODAY}') > 30")
def stale_reviewed(t: Tables) -> DataFrame:
    return doc_key(checks.stale_reviews(docs(t), F.lit(TODAY).cast("date"), 30))


@query(f"SELECT id FROM ({DOCS}) WHERE bare")
def missing_frontmatter(t: Tables) -> DataFrame:
    return doc_key(checks.missing_frontmatter(docs(t)))


@query(f"SELECT id FROM ({DOCS}) WHERE NOT bare AND status = 'prototype'")
def prototype_docs(t: Tables) -> DataFrame:
    return doc_key(checks.prototypes(docs(t)))


@query(f"""
SELECT d.id, l.l_partkey AS related FROM ({DOCS}) d JOIN lineitem l ON l.l_orderkey = d.id
JOIN (SELECT l_partkey, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1) c ON c.l_partkey = l.l_partkey
WHERE NOT d.bare AND d.status = 'active' AND c.last > d.reviewed::DATE""")
def related_drift(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_orderkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), F.col("l_linenumber").alias("pos"))
    commits = t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_shipdate").cast("date").alias("last_commit"))
    out = checks.drifted_related(edges, docs(t), commits)
    return out.select(F.col("doc").cast("long").alias("id"), F.col("related_file").cast("long").alias("related"))


@query("SELECT l_orderkey AS doc, l_partkey AS related FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0)")
def broken_related(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    out = checks.broken_related(edges, t.part.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("path")))
    return out.select("doc", F.col("related_file").alias("related"))


LINK = "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem"


@query(f"WITH e AS ({LINK}) SELECT src AS doc, dst AS related FROM e WHERE dst % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)")
def one_way_link(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    known = t.supplier.select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 4 != 0, "x").alias("frontmatter"))
    return checks.one_way_links(edges, known).select("doc", F.col("related_file").alias("related"))


PLACE = "'d' || (p_partkey // 3) || '/' || p_partkey || CASE WHEN p_partkey % 4 < 3 THEN '.txt' ELSE '.md' END"


@query(f"""
WITH f AS (SELECT p_partkey, {PLACE} AS path FROM part), m AS (SELECT * FROM f WHERE path LIKE '%.md'),
s AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS n FROM m GROUP BY 1)
SELECT path FROM m JOIN s ON s.dir = split_part(path, '/', 1) WHERE n = 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 3 = 0)""")
def orphan_docs(t: Tables) -> DataFrame:
    def place(key: str) -> F.Column:
        k = F.col(key)
        return F.concat(F.lit("d"), F.floor(k / 3).cast("string"), F.lit("/"), k.cast("string"), F.when(k % 4 < 3, ".txt").otherwise(".md"))

    files = t.part.select(place("p_partkey").alias("path"))
    edges = t.lineitem.filter("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("src"), place("l_partkey").alias("dst"))
    return checks.orphans(files.filter(F.col("path").endswith(".md")), edges, files).select(F.col("doc").alias("path"))


SITE = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query(f"SELECT page_id FROM (SELECT page_id, {SITE} || '.md' AS path FROM pages) WHERE NOT starts_with(path, 'en/') AND NOT starts_with(path, 'de/')")
def homeless(t: Tables) -> DataFrame:
    path = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), F.lit(".md"))
    rows = t.pages.select("page_id", path.alias("path"))
    found = checks.homeless(rows, "en/", excluded=["de/"])
    return rows.join(found.select(F.col("doc").alias("path")).distinct(), "path", "left_semi").select("page_id")


@query(f"SELECT DISTINCT regexp_extract({SITE}, '^([^/]*)/', 1) || '/docs' AS dir FROM pages WHERE {SITE} LIKE '%/%'")
def nested_docs(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    rows = t.pages.filter(path.contains("/")).select(F.concat(F.regexp_extract(path, "^([^/]*)/", 1), F.lit("/docs/"), "page_id", F.lit(".md")).alias("path"))
    return checks.nested_docs(rows).select(F.col("doc").alias("dir"))


@query(f"""
WITH i AS (SELECT 'info' AS severity FROM ({DOCS}) WHERE bare OR status = 'prototype'
UNION ALL SELECT 'error' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0))
SELECT s.severity, count(i.severity) AS n FROM (VALUES ('error'), ('warning'), ('info')) s(severity) LEFT JOIN i USING (severity) GROUP BY 1""")
def issues_by_severity(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_orderkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    files = t.part.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").cast("string").alias("path"))
    return checks.by_severity(checks.all_issues([checks.missing_frontmatter(docs(t)), checks.prototypes(docs(t)), checks.broken_related(edges, files)]))


@query(f"""
SELECT count(*) AS total_docs, count(*) FILTER (NOT bare) AS with_frontmatter, count(*) FILTER (NOT bare AND status = 'active') AS active,
  count(*) FILTER (NOT bare AND status = 'prototype') AS prototype, count(*) FILTER (NOT bare AND status = 'archived') AS archived FROM ({DOCS})""")
def scan_statistics(t: Tables) -> DataFrame:
    issues = checks.prototypes(docs(t))
    return checks.statistics(docs(t), t.labels, issues).select("total_docs", "with_frontmatter", "active", "prototype", "archived")


@query("""
SELECT n_name AS path, CASE WHEN n_regionkey % 2 = 0 THEN 'no sidecar' ELSE 'sidecar is pending' END AS detail FROM nation WHERE n_regionkey % 2 = 0 OR n_nationkey % 3 = 0""")
def induction_needed(t: Tables) -> DataFrame:
    media = t.nation.select(F.col("n_name").alias("path"))
    state = t.nation.filter("n_regionkey % 2 <> 0").select(F.col("n_name").alias("current_path"), F.when(F.col("n_nationkey") % 3 == 0, "pending").otherwise("embedded").alias("status"))
    return checks.induction_needed(media, state).select(F.col("doc").alias("path"), "detail")


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0 AND conv_id % 5 <> 0")
def unprocessed_transcripts(t: Tables) -> DataFrame:
    talks = t.conversations.select("conv_id").distinct()
    named = talks.select(F.concat(F.lit("audio/"), "conv_id", F.lit(".txt")).alias("path"))
    files = talks.filter("conv_id % 3 = 0").select(F.concat(F.lit("out/"), "conv_id", F.lit("-summary.md")).alias("path"))
    side = talks.filter("conv_id % 5 = 0").select(F.concat(F.lit("audio/"), "conv_id", F.lit(".txt")).alias("current_path"), F.lit("fulfilled").alias("status"))
    out = checks.unprocessed_transcripts(named, files, side)
    return out.select(F.regexp_extract("doc", r"(\d+)\.txt$", 1).cast("long").alias("conv_id"))


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.n_chars > 1000")
def embed_drift(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").cast("double").alias("mtime"))
    side = t.labels.select(F.col("doc_id").alias("current_path"), F.when(F.col("quality") == 1, "embedded").otherwise("pending").alias("status"), F.lit(1000.0).alias("file_mtime"))
    return checks.embed_drift(files, side).select(F.col("doc").alias("doc_id"))


# ---- audit

META = "SELECT o_orderkey::VARCHAR AS sidecar_id, o_orderkey % 7 + 1 AS chunk_count FROM orders WHERE o_orderkey % 10 <> 0"
CHUNKS = "SELECT l_orderkey::VARCHAR AS sidecar_id, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 13 <> 0"


def registry(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.filter("o_orderkey % 10 <> 0").select(
        k.cast("string").alias("sidecar_id"), F.concat(F.lit("docs/"), k, F.lit(".md")).alias("file_path"), F.concat(F.lit(".loom/sidecars/"), k, F.lit(".embed-meta.yaml")).alias("sidecar_path"),
        (k % 7 + 1).cast("int").alias("chunk_count"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("file_mtime"), F.lit(None).cast("string").alias("last_embedded"),
        F.sha2(F.col("o_orderstatus"), 256).alias("file_hash"), F.concat(F.lit("docs/"), k, F.lit(".md")).alias("current_path"),
    )


def index(t: Tables) -> DataFrame:
    from ..sources.corpus import chunk_index

    k = F.col("l_orderkey")
    points = t.lineitem.filter("l_orderkey % 13 <> 0").select(k.cast("string").alias("sidecar_id"), F.col("l_linenumber").alias("chunk_index"), F.concat_ws(":", k, "l_linenumber", "l_partkey").alias("point_id"), F.concat(F.lit("part "), "l_partkey").alias("text"), F.lit("spec").alias("doc_type"), F.concat(F.lit("docs/"), k, F.lit(".md")).alias("file_path"))
    return chunk_index(points)


@query(f"""
SELECT 'orphaned_' || left(sidecar_id, 8) AS id, sidecar_id, count(*) AS chunk_count, arg_min('part ' || l_partkey, l_linenumber || ':' || l_partkey) AS first_chunk_text,
  list(sidecar_id || ':' || l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey::VARCHAR) AS chunk_ids
FROM ({CHUNKS}) WHERE sidecar_id NOT IN (SELECT sidecar_id FROM ({META})) GROUP BY sidecar_id""")
def orphaned_chunks(t: Tables) -> DataFrame:
    return audit.orphaned_chunks(index(t), registry(t)).select("id", "sidecar_id", "chunk_count", "first_chunk_text", "chunk_ids")


@query(f"SELECT sidecar_id, '.loom/sidecars/docs/' || sidecar_id || '.md.embed-meta.yaml' AS expected_sidecar_path FROM ({CHUNKS}) WHERE sidecar_id NOT IN (SELECT sidecar_id FROM ({META})) GROUP BY 1")
def missing_sidecar(t: Tables) -> DataFrame:
    return audit.missing_sidecars(index(t), registry(t)).select("sidecar_id", "expected_sidecar_path")


@query(f"""
SELECT m.sidecar_id, m.chunk_count::BIGINT AS recorded_chunk_count, coalesce(c.n, 0) AS actual_chunk_count
FROM ({META}) m LEFT JOIN (SELECT sidecar_id, count(*) AS n FROM ({CHUNKS}) GROUP BY 1) c USING (sidecar_id) WHERE coalesce(c.n, 0) <> m.chunk_count""")
def count_mismatch(t: Tables) -> DataFrame:
    return audit.count_mismatches(registry(t), index(t)).select("sidecar_id", "recorded_chunk_count", "actual_chunk_count")


def files(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    late = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.when(k % 3 == 0, 86_400).otherwise(0)
    return t.orders.filter("o_orderkey % 17 <> 0").select(F.concat(F.lit("docs/"), k, F.lit(".md")).alias("path"), late.cast("double").alias("mtime"), F.sha2(F.when(k % 4 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")), 256).alias("hash"))


@query("SELECT o_orderkey::VARCHAR AS sidecar_id, greatest(0, date_diff('second', o_orderdate, TIMESTAMP '2000-01-01') // 86400)::INT AS days_stale FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0")
def stale_sidecar(t: Tables) -> DataFrame:
    return audit.stale_sidecars(registry(t), files(t), F.lit("2000-01-01").cast("timestamp")).select("sidecar_id", "days_stale")


@query("SELECT o_orderkey::VARCHAR AS sidecar_id, sha256(o_orderstatus) AS recorded_hash, sha256('X') AS actual_hash FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 4 = 0 AND o_orderstatus <> 'X'")
def hash_mismatch(t: Tables) -> DataFrame:
    return audit.hash_mismatches(registry(t), files(t)).select("sidecar_id", "recorded_hash", "actual_hash")


@query("SELECT 'docs/' || o_orderkey || '.md' AS file_path FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 10 = 0 AND (o_orderkey % 13 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def disconnected(t: Tables) -> DataFrame:
    return audit.disconnected_files(files(t), registry(t), index(t)).select("file_path")


@query("SELECT 'docs/' || o_orderkey || '.md' AS missing_source FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 17 = 0")
def missing_source(t: Tables) -> DataFrame:
    return audit.missing_sources(registry(t), files(t)).select("missing_source")


@query(f"""
WITH o AS (SELECT DISTINCT sidecar_id FROM ({CHUNKS}) WHERE sidecar_id NOT IN (SELECT sidecar_id FROM ({META})))
SELECT 'orphaned_chunks' AS category, count(*) AS n FROM o UNION ALL SELECT 'missing_sidecars', count(*) FROM o
UNION ALL SELECT 'missing_source_sidecars', count(*) FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 17 = 0
UNION ALL SELECT 'stale_sidecars', count(*) FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0
UNION ALL SELECT 'hash_mismatches', count(*) FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 4 = 0 AND o_orderstatus <> 'X'
UNION ALL SELECT 'disconnected_files', count(*) FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 10 = 0 AND (o_orderkey % 13 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'qdrant_sidecar_mismatches', count(*) FROM ({META}) m LEFT JOIN (SELECT sidecar_id, count(*) AS n FROM ({CHUNKS}) GROUP BY 1) c USING (sidecar_id) WHERE coalesce(c.n, 0) <> m.chunk_count""")
def audit_by_category(t: Tables) -> DataFrame:
    return audit.by_category(audit.audit(files(t), registry(t), registry(t), index(t), F.lit("2000-01-01").cast("timestamp")))


# ---- lifecycle


@query("""
WITH new AS (SELECT user_id AS k, arg_max(value, event_id) AS value FROM events GROUP BY 1), old AS (SELECT c_custkey AS k, c_acctbal AS value FROM customer)
SELECT k, value FROM new UNION ALL SELECT k, value FROM old WHERE k NOT IN (SELECT k FROM new)""")
def upsert_merge(t: Tables) -> DataFrame:
    state = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    return lifecycle.upsert(state, t.events.select(F.col("user_id").alias("k"), "value", "event_id"), ["k"], [F.desc("event_id")])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_version(t: Tables) -> DataFrame:
    return lifecycle.latest(t.events, ["user_id"], [F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2")
def version_history(t: Tables) -> DataFrame:
    return lifecycle.last_versions(t.events, ["user_id"], [F.desc("event_id")], 2).select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE NOT (ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type <> 'view')")
def ttl_expire(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").cast("timestamp")).scalar()
    rows = t.events.select("event_id", now.alias("now"), F.col("ts").cast("timestamp").alias("orphaned_at"), F.when(F.col("event_type") == "view", "").otherwise("x").alias("sidecar_id"))
    return lifecycle.expire(rows, F.col("now"), 7).select("event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'stale' ELSE l_linestatus END AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def mark_stale(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("sidecar_id"), F.col("l_linestatus").alias("status"), F.lit(None).cast("timestamp").alias("stale_as_of"))
    stale = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("sidecar_id"))
    return lifecycle.mark_stale(rows, stale, F.lit("2000-01-01").cast("timestamp")).select("l_orderkey", "l_linenumber", "status")


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'skip_mtime' WHEN doc_id % 2 = 0 THEN 'skip_hash' ELSE 'reembed' END AS action,
  CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 3 <> 0 AND doc_id % 2 <> 0 THEN 3 ELSE 2 END::INT AS generation FROM documents""")
def change_detect(t: Tables) -> DataFrame:
    d, h = F.col("doc_id"), F.sha2("text", 256)
    now = t.documents.select(d.alias("path"), F.when(d % 3 == 0, 1.0).otherwise(2.0).alias("mtime"), h.alias("hash"))
    state = t.documents.filter("doc_id % 5 <> 0").select(d.alias("path"), F.lit(1.0).alias("file_mtime"), F.when(d % 2 == 0, h).otherwise("old").alias("file_hash"), F.lit(2).alias("generation"))
    return lifecycle.detect_changes(state, now).withColumnRenamed("path", "doc_id")


@query("""
WITH b AS (SELECT c_custkey AS id, c_name AS doc, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'persisting' ELSE 'resolved' END AS state FROM customer WHERE c_custkey % 4 <> 0),
n AS (SELECT c_custkey, c_name AS doc FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(b.id, (SELECT max(id) FROM b) + row_number() OVER (PARTITION BY b.id IS NULL ORDER BY n.doc)) AS id, coalesce(b.doc, n.doc) AS doc,
  CASE WHEN b.id IS NULL THEN 'new' WHEN n.doc IS NOT NULL AND b.state <> 'resolved' THEN 'persisting' WHEN n.doc IS NOT NULL THEN 'new' WHEN b.state = 'resolved' THEN 'archived' ELSE 'resolved' END AS state
FROM b FULL JOIN n ON b.doc = n.doc""")
def issue_lifecycle(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    before = t.customer.filter("c_custkey % 4 <> 0").select(k.alias("id"), F.col("c_name").alias("doc"), F.lit("x").alias("type"), F.when(k % 3 == 0, "new").when(k % 3 == 1, "persisting").otherwise("resolved").alias("state"))
    now = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("doc"), F.lit("x").alias("type"))
    return lifecycle.issue_history(before, now).select("id", "doc", "state")


@query("SELECT stale, total, CASE WHEN stale >= 0.3 * total THEN printf('%d of %d (%d%%) are stale', stale, total, (100 * stale // total)) END AS message FROM (SELECT count(*) FILTER (quality = 0 OR doc_id % 3 = 0) AS stale, count(*) AS total FROM labels)")
def stale_alert(t: Tables) -> DataFrame:
    state = t.labels.select(F.when((F.col("quality") == 0) | (F.col("doc_id") % 3 == 0), "stale").otherwise("embedded").alias("status"))
    return lifecycle.stale_alert(state).select("stale", "total", "message")


@query("SELECT count(*) FILTER (quality = 1) AS embedded, count(*) FILTER (quality = 0) AS skipped, 0::BIGINT AS error FROM labels")
def run_summary(t: Tables) -> DataFrame:
    return lifecycle.run_summary(t.labels.select(F.when(F.col("quality") == 1, "embedded").otherwise("skipped").alias("outcome")))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def auto_induct(t: Tables) -> DataFrame:
    f = t.documents.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"))
    s = t.labels.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("current_path"))
    return lifecycle.induct(f, s, "p").select(F.regexp_extract("current_path", r"(\d+)", 1).cast("long").alias("doc_id"))


@query("SELECT DISTINCT doc_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1")
def pending_files(t: Tables) -> DataFrame:
    from ..sources.corpus import pending

    s = t.labels.select(F.col("doc_id").alias("current_path"), F.when(F.col("toxic") == 1, "pending").otherwise("embedded").alias("status"))
    return pending(s, t.documents.select(F.col("doc_id").alias("path"))).select(F.col("current_path").alias("doc_id")).distinct()


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("SELECT DISTINCT user_id::VARCHAR || '.md' AS path FROM events WHERE event_id > (SELECT count(*) // 2 FROM events) AND user_id % 6 <> 0")
def changed_since(t: Tables) -> DataFrame:
    from ..sources.corpus import changed_since as since

    half = t.events.count() // 2
    log = t.events.select(F.concat("user_id", F.when(F.col("user_id") % 6 == 0, ".txt").otherwise(".md")).alias("path"), F.col("event_id").cast("string").alias("commit"), F.timestamp_seconds("event_id").alias("committed"))
    return since(log, str(half))


# ---- what Spark gives besides (no counterpart there: extensions)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_extension(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS begun FROM g GROUP BY user_id, k""")
def session_windows_extension(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("ts")).alias("begun")).select("user_id", "n", "begun")
