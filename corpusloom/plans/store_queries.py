"""Queries of collections and model calls on the shared tables.

Stand-ins: orders are documents, (a document, line number) a chunk, its largest part key the content; the model counts words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, models, store
from .registry import Tables, query

#: Words, with the prefix, that the stand-in model takes.
FITS = 200


def chunks(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("slug"), F.col("l_linenumber").cast("int").alias("chunk_index")).agg(F.max("l_partkey").alias("p"))
    return lines.withColumn("text", F.concat(F.lit("c"), "p"))


CHUNKS = "SELECT l_orderkey::VARCHAR AS slug, l_linenumber::INT AS chunk_index, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2"


@query(f"""
SELECT md5(slug || ':' || chunk_index || CASE WHEN chunk_index % 3 = 0 THEN '' ELSE ':g' || chunk_index END)::UUID::VARCHAR AS id, slug, chunk_index, 'c' || p AS text,
  CASE WHEN chunk_index % 3 = 0 THEN 1 ELSE chunk_index END::INT AS doc_generation, CASE WHEN p % 2 = 0 THEN '' ELSE 's' || slug END AS sidecar_id, '' AS chunk_source_hash, NULL::VARCHAR AS stale_as_of
FROM ({CHUNKS}) WHERE p % 11 <> 0""")
def chunk_points(t: Tables) -> DataFrame:
    rows = chunks(t).withColumn("vector", F.when(F.col("p") % 11 != 0, F.array(F.col("p").cast("float"))))
    rows = rows.withColumn("doc_generation", F.when(F.col("chunk_index") % 3 != 0, F.col("chunk_index"))).withColumn("sidecar_id", F.when(F.col("p") % 2 == 1, F.concat(F.lit("s"), "slug")))
    return store.points(rows).select("id", "slug", "chunk_index", "text", "doc_generation", "sidecar_id", "chunk_source_hash", "stale_as_of")


@query("SELECT DISTINCT md5(p_partkey || ':visual:' || p_size)::UUID::VARCHAR AS id, p_partkey::VARCHAR AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'plan' ELSE 'visual_page' END AS doc_type FROM part WHERE p_partkey % 5 <> 0")
def visual_points(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(k.cast("string").alias("slug"), F.col("p_size").cast("int").alias("page_num"), F.when(k % 5 != 0, F.array(F.array(F.lit(1.0)))).alias("vectors"), F.when(k % 3 == 0, "plan").alias("doc_type"), F.lit(b"").alias("png_bytes"))
    return store.visual_points(rows).select("id", "slug", "doc_type")


def _picky():
    def put(points: list[dict]) -> None:
        if any(p["p"] % 13 == 0 for p in points):
            raise OSError("store is down")

    return put


@query(f"""
SELECT slug, batch::INT AS batch, CASE WHEN bool_or(p % 13 = 0) THEN 0 ELSE count(*) END::INT AS sent
FROM (SELECT slug, p, (row_number() OVER (PARTITION BY slug ORDER BY chunk_index) - 1) // 2 AS batch FROM ({CHUNKS})) GROUP BY 1, 2""")
def upsert_batches(t: Tables) -> DataFrame:
    """Batches of two; a store that fails takes none of a batch."""
    return store.send(chunks(t).select("slug", "chunk_index", "p"), "chunk_index", _picky, 2)


def _counting():
    def embed(text: str) -> list[float]:
        n = len(text.split())
        if n > FITS:
            raise models.TooLong(str(n))
        return [float(n)]

    return embed


@query(f"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS a FROM documents), m AS (SELECT *, a * 3 // 4 AS b, (a * 3 // 4) * 3 // 4 AS c, ((a * 3 // 4) * 3 // 4) * 3 // 4 AS d FROM n)
SELECT doc_id, CASE WHEN a IS NULL THEN NULL WHEN a < {FITS} THEN a + 1 WHEN b < {FITS} THEN b + 1 WHEN c < {FITS} THEN c + 1 WHEN d < {FITS} THEN d + 1 END::FLOAT AS words,
  CASE WHEN a IS NULL THEN 'ValueError' WHEN d >= {FITS} THEN 'TooLong' END AS error FROM m""")
def embed_shortened(t: Tables) -> DataFrame:
    """Words of the text, prefix included, that the model took in the end."""
    out = models.embedded(t.documents, _counting, key=["doc_id"])
    return out.select("doc_id", F.col("vector")[0].alias("words"), F.substring_index("error", ":", 1).alias("error"))


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def missing_names(t: Tables) -> DataFrame:
    return checks.missing_names(t.part.select(F.col("p_partkey").alias("name")), t.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").alias("name")), t.supplier.select(F.col("s_suppkey").alias("name")))


@query("""
SELECT slug, CASE WHEN bool_or(p % 10 = 9) THEN 0 ELSE 4 - count(DISTINCT p % 10) FILTER (p % 10 < 4) END::INT AS missing
FROM (SELECT l_orderkey AS slug, l_partkey AS p FROM lineitem) GROUP BY 1""")
def unlisted_entries(t: Tables) -> DataFrame:
    """Lines end in the last digit of a part; 9 covers the folder, and 0 to 3 are wanted."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("slug")).agg(F.collect_list((F.col("l_partkey") % 10).cast("string")).alias("lines"))
    wanted = F.array(*[F.lit(str(i)) for i in range(4)])
    return lines.select("slug", F.size(checks.unlisted(F.col("lines"), wanted, F.array(F.lit("9")))).alias("missing"))
