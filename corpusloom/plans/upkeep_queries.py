"""Queries of metadata upkeep, sources and page routing on the shared tables.

Stand-ins: orders are metadata files (path = order key), line items their related entries, stored chunks, images or commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import checks, chunking, lifecycle, pages
from ..sources import corpus
from .registry import Tables, query
from .text_queries import PATH, url_path


def sidecars(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(F.concat(F.lit("s"), k).alias("sidecar_path"), F.when(k % 5 != 0, k.cast("string")).alias("current_path"), (k % 7 == 0).alias("failed"))


def sources(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("path"))


@query("""
SELECT 's' || o_orderkey AS doc, CASE WHEN o_orderkey % 5 = 0 THEN 'sidecar_missing_path' ELSE 'sidecar_path_drift' END AS type, CASE WHEN o_orderkey % 5 = 0 THEN 'info' ELSE 'warning' END AS severity,
  CASE WHEN o_orderkey % 5 = 0 THEN 'no current_path' ELSE 'missing: ' || o_orderkey END AS detail FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0)""")
def sidecar_path_drift(t: Tables) -> DataFrame:
    return checks.sidecar_paths(sidecars(t), sources(t)).select("doc", "type", "severity", "detail")


@query("SELECT 's' || o_orderkey AS doc, 'sidecar_parse_error' AS type, 'error' AS severity FROM orders WHERE o_orderkey % 7 = 0")
def sidecar_parse_error(t: Tables) -> DataFrame:
    return checks.sidecar_errors(sidecars(t)).select("doc", "type", "severity")


@query("SELECT 's' || l_orderkey AS doc, l_partkey::VARCHAR AS related_file FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0)")
def sidecar_broken_related(t: Tables) -> DataFrame:
    side = t.lineitem.groupBy(F.concat(F.lit("s"), "l_orderkey").alias("sidecar_path")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("related_docs"))
    return checks.sidecar_broken_related(side, t.part.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").cast("string").alias("path"))).select("doc", "related_file")


@query("SELECT 's' || o_orderkey AS sidecar_path FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0")
def orphaned_sidecars(t: Tables) -> DataFrame:
    return lifecycle.orphaned(sidecars(t), sources(t)).select("sidecar_path")


@query("""
SELECT sidecar_id, max(sidecar_path) AS sidecar_path, arg_max(l_partkey, sidecar_path)::VARCHAR AS current_path, CASE WHEN arg_max(l_partkey, sidecar_path) % 9 <> 0 THEN arg_max(l_partkey, sidecar_path)::VARCHAR END AS file_path
FROM (SELECT l_orderkey::VARCHAR AS sidecar_id, 's/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS sidecar_path, l_partkey FROM lineitem WHERE l_linenumber <> 3 AND NOT regexp_matches('s/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey, '(^|/)5/1')) GROUP BY 1""")
def sidecar_registry(t: Tables) -> DataFrame:
    key = F.concat(F.lit("s/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit("/"), "l_partkey")
    side = t.lineitem.select(F.col("l_orderkey").cast("string").alias("sidecar_id"), key.alias("sidecar_path"), F.col("l_partkey").cast("string").alias("current_path"), (F.col("l_linenumber") == 3).alias("failed"))
    there = t.part.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").cast("string").alias("path"))
    return corpus.registry(side, there, ["5/1"]).select("sidecar_id", "sidecar_path", "current_path", "file_path")


@query("""
WITH old AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 4 <> 0),
new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' END AS name, CASE WHEN c_custkey % 5 = 0 THEN 99::INT END AS nation FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.k, new.k) AS k, coalesce(new.nation, old.nation, -1)::INT AS nation, coalesce(new.name, old.name, '') AS name FROM old FULL JOIN new ON old.k = new.k""")
def merge_update(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    old = t.customer.filter("c_custkey % 4 <> 0").select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation"))
    new = t.customer.filter("c_custkey % 2 = 0").select(k.alias("k"), F.when(k % 3 == 0, "renamed").alias("name"), F.when(k % 5 == 0, F.lit(99)).alias("nation"))
    return lifecycle.merge_update(old, new, "k").fillna({"nation": -1, "name": ""})


@query("""
WITH s AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '.loom/sidecars/' ELSE '' END || 'd' || (p_partkey // 2) || '.yaml' AS sidecar_path, p_partkey FROM part),
m AS (SELECT CASE WHEN starts_with(sidecar_path, '.loom/sidecars/') THEN sidecar_path ELSE '.loom/sidecars/' || sidecar_path END AS sidecar_path, NOT starts_with(sidecar_path, '.loom/sidecars/') AS old, p_partkey FROM s)
SELECT sidecar_path, arg_min(p_partkey, old) AS p_partkey FROM m GROUP BY 1""")
def migrate_sidecars(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    side = t.part.select(F.concat(F.when(k % 2 == 0, ".loom/sidecars/").otherwise(""), F.lit("d"), F.floor(k / 2), F.lit(".yaml")).alias("sidecar_path"), "p_partkey")
    return lifecycle.migrate(side)


@query("""
SELECT '.loom/sidecars/d/' || p_partkey || '.embed-meta.yaml' AS sidecar_path,
  CASE WHEN p_partkey % 4 = 0 THEN 'kept' WHEN p_partkey % 3 = 0 THEN 'd/' || p_partkey || '.pdf' WHEN p_partkey % 5 = 0 THEN 'd/' || p_partkey || '.md' END AS current_path FROM part""")
def heal_sidecars(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda end: F.concat(F.lit("d/"), k, F.lit(end))
    side = t.part.select(F.concat(F.lit(".loom/sidecars/"), name(".embed-meta.yaml")).alias("sidecar_path"), F.when(k % 4 == 0, "kept").when(k % 4 == 1, "").alias("current_path"))
    found = t.part.filter("p_partkey % 3 = 0").select(name(".pdf").alias("path")).unionByName(t.part.filter("p_partkey % 5 = 0").select(name(".md").alias("path"))).unionByName(t.part.select(name(".txt").alias("path")))
    return lifecycle.heal(side, found)


@query(f"SELECT page_id FROM (SELECT page_id, {PATH} AS path FROM pages) WHERE path LIKE 'en/1%' OR path LIKE '%/en/1%' OR path LIKE '%/2%' OR path LIKE '2%'")
def audit_exclusion(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url_path("url").alias("path")).filter(text.excluded_inside(F.col("path"), ["en/1*", "2*"])).select("page_id")


@query(f"SELECT page_id FROM (SELECT page_id, {PATH} AS path FROM pages) WHERE starts_with(path, 'en/') AND NOT regexp_matches(path, '(^|/)1[^/]*html$')")
def tracked_docs(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", url_path("url").alias("path"))
    return corpus.tracked(rows, "en/", ["1*html"]).select("page_id")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 2) AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0")
def embeddable_media(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    folder = F.when(k % 3 == 0, "audio/x/").when(k % 3 == 1, "audiox/").otherwise("other/")
    end = F.when(k % 4 == 0, ".pdf").when(k % 4 == 1, ".txt").when(k % 4 == 2, ".MP3").otherwise("")
    rows = t.part.select("p_partkey", F.concat(folder, F.when(k % 5 == 0, ".").otherwise("f"), k, end).alias("path"))
    return corpus.media(rows, ["audio/", "specs"]).select("p_partkey")


@query("SELECT l_partkey AS path, max(l_shipdate)::DATE::VARCHAR AS last_commit FROM lineitem GROUP BY 1")
def last_commits(t: Tables) -> DataFrame:
    return corpus.last_commits(t.lineitem.select(F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("committed"))).select("path", F.col("last_commit").cast("string").alias("last_commit"))


@query("SELECT arg_max(event_id, event_id)::VARCHAR AS head, arg_min(event_id, event_id)::VARCHAR AS first FROM events")
def log_heads(t: Tables) -> DataFrame:
    return corpus.heads(t.events.select(F.col("event_id").cast("string").alias("commit"), F.timestamp_seconds("event_id").alias("committed")))


@query("""
WITH g AS (SELECT l_orderkey AS src, list(l_partkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem GROUP BY 1)
SELECT src, unnest(r) AS dst, (generate_subscripts(r, 1) - 1)::INT AS pos FROM g""")
def related_edges(t: Tables) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("path")).agg(F.struct(F.transform(order, lambda x: x["l_partkey"]).alias("related")).alias("frontmatter"))
    return corpus.edges(rows)


@query("SELECT page_id AS path FROM pages WHERE page_id % 4 = 0")
def lfs_not_pulled(t: Tables) -> DataFrame:
    start = F.when(F.col("page_id") % 4 == 0, "version https://git-lfs.github.com/spec/v1\noid ").when(F.col("page_id") % 4 == 1, " version https://git-lfs.github.com/spec/v1").otherwise("")
    found = t.pages.select(F.col("page_id").alias("path"), F.encode(F.concat(start, "html"), "utf-8").alias("content"))
    return checks.lfs_not_pulled(found).select(F.col("doc").alias("path"))


@query("SELECT l_orderkey, bool_or(abs(l_quantity * l_suppkey) >= 0.05 * 100 * 50) AS significant FROM lineitem GROUP BY 1")
def significant_image(t: Tables) -> DataFrame:
    size = lambda c: F.col(c).cast("double")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(size("l_quantity").alias("w"), size("l_suppkey").alias("h"))).alias("images"))
    return rows.select("l_orderkey", pages.significant_image(F.col("images"), F.lit(100.0), F.lit(50.0)).alias("significant"))


@query("""
SELECT count(*) FILTER (o_orderkey % 4 = 0) AS pass, count(*) FILTER (o_orderkey % 4 = 1) AS fail, count(*) FILTER (o_orderkey % 4 = 2) AS warn,
  count(*) FILTER (o_orderkey % 4 = 3) AS skip, count(*) FILTER (o_orderkey % 6 = 1) AS fixable FROM orders""")
def checks_by_status(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "pass").when(k % 4 == 1, "fail").when(k % 4 == 2, "warn").otherwise("skip")
    return pages.checks_by_status(t.orders.select(status.alias("status"), (k % 6 == 1).alias("fixable")))


@query("SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag <> 'R') AS text_chunks, count(*) FILTER (l_returnflag = 'R') AS image_chunks, count(*) AS chunk_count FROM lineitem GROUP BY 1")
def chunk_totals(t: Tables) -> DataFrame:
    return lifecycle.chunk_totals(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("kind")))


@query("""
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
c AS (SELECT doc_id, 0 AS k, i, 0 AS part, 'text ' || p AS text FROM l WHERE i <= 2 UNION ALL
  SELECT doc_id, 1, i, q.j, CASE WHEN p % 2 = 0 THEN 'image ' || p ELSE array_to_string(list_transform(range(1, CASE q.j WHEN 0 THEN 8 ELSE 4 END), lambda x: 'w' || p), ' ') END
  FROM l, LATERAL (SELECT unnest(range(0, CASE WHEN p % 2 = 0 THEN 1 ELSE 2 END)) AS j) q WHERE i > 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i, part) - 1)::INT AS chunk_index, CASE k WHEN 0 THEN 'text' ELSE 'image' END AS kind, i::INT AS page, text FROM c""")
def image_chunks(t: Tables) -> DataFrame:
    """Descriptions of ten words are cut into windows of seven and three."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page")).agg(F.max("l_partkey").alias("p"))
    texts = lines.filter("page <= 2").select("doc_id", F.col("page").alias("chunk_index"), "page", F.concat(F.lit("text "), "p").alias("text"))
    long = F.array_join(F.array_repeat(F.concat(F.lit("w"), "p"), 10), " ")
    images = lines.filter("page > 2").select("doc_id", "page", F.lit(1).alias("image"), F.when(F.col("p") % 2 == 0, F.concat(F.lit("image "), "p")).otherwise(long).alias("text"))
    return chunking.with_image_chunks(texts, images, 10)


@query("""
SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/?[^/]*$', '') AS folder, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.(\\.[^.]+)$', 1)) AS suffix
FROM (SELECT page_id, """ + PATH + """ AS path FROM pages)""")
def path_parts(t: Tables) -> DataFrame:
    path = url_path("url")
    return t.pages.select("page_id", text.basename(path).alias("name"), text.parent(path).alias("folder"), text.suffix(path).alias("suffix"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_partkey % 7, p_partkey, 3]::INT[] WHEN 1 THEN [0]::INT[] ELSE [2, 10]::INT[] END AS numbers FROM part")
def version_numbers(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    version = F.when(k % 3 == 0, F.concat_ws(".", k % 7, k, F.lit("3rc1"))).when(k % 3 == 1, F.concat(k, F.lit(".x.1"))).otherwise("2.10")
    return t.part.select("p_partkey", text.version_numbers(version).alias("numbers"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'a/' || p_partkey || '.md' WHEN p_partkey % 4 = 1 THEN 's' || p_partkey WHEN p_partkey % 4 = 2 THEN 's' || p_partkey ELSE '' END AS label FROM part")
def hit_labels(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("a/"), k, F.lit(".md"))).when(k % 4 == 1, "")
    return t.part.select("p_partkey", text.label(path, F.when(k % 4 != 3, F.concat(F.lit("s"), k))).alias("label"))


@query("SELECT doc_id, sha256(replace(text, chr(10), chr(13) || chr(10))) AS exact, sha256(text) AS folded FROM documents WHERE NOT contains(text, chr(13))")
def hash_by_kind(t: Tables) -> DataFrame:
    """Text files are hashed with plain line ends, others byte for byte."""
    rows = t.documents.filter(~F.contains("text", F.lit("\r"))).select("doc_id", F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "utf-8").alias("content"))
    return rows.select("doc_id", ids.file_hash(F.col("content"), F.lit("a.pdf")).alias("exact"), ids.file_hash(F.col("content"), F.lit("a.md")).alias("folded"))
