"""Queries of vector search, the related graph, scopes and score bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import graph, search
from ..session import checkpoint
from .registry import Tables, query

COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
PER_QUERY = f"""
SELECT q.vec_id AS query_id, p.vec_id AS id, {COS.format('q.embedding', 'p.embedding')} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format('q.embedding', 'p.embedding')} DESC, p.vec_id) AS rank
FROM embeddings q JOIN embeddings p ON p.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0"""
EVERY_EDGE = f"SELECT query_id AS src, id AS dst, (rank - 1)::INT AS pos FROM ({PER_QUERY.replace(' WHERE q.vec_id % 50 = 0', '')}) WHERE rank <= 4"
EDGES = f"SELECT query_id AS src, id AS dst, (rank - 1)::INT AS pos FROM ({PER_QUERY}) WHERE rank <= 4"


def points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def queries(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"SELECT p.vec_id AS id, round({COS.format('p.embedding', 'q.embedding')}, 6) AS score FROM embeddings p, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS.format('p.embedding', 'q.embedding')} DESC, 1 LIMIT 5")
def knn_topk(t: Tables) -> DataFrame:
    first = t.embeddings.filter("vec_id = 0").select("embedding").first()
    return rounded(search.top_k(points(t), list(first[0]), 5).select("id", "score"))


@query(f"SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM ({PER_QUERY}) WHERE rank <= 5")
def knn_per_query(t: Tables) -> DataFrame:
    return rounded(search.nearest(points(t), queries(t), 5).select("query_id", "id", "score", "rank"))


@query(f"SELECT query_id, 'src' || (id % 20) AS source, round(score, 4) AS score FROM ({PER_QUERY}) WHERE rank <= 6 AND score >= 0.35")
def suggest_related(t: Tables) -> DataFrame:
    named = points(t).withColumn("source", F.concat(F.lit("src"), F.col("id") % 20))
    return search.suggestions(named, queries(t), 6, 0.35).select("query_id", "source", "score")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS.format('a.embedding', 'b.embedding')} > 0.40")
def near_dup(t: Tables) -> DataFrame:
    return rounded(search.near_duplicates(points(t), 0.40))


@query("""
WITH m AS (SELECT vec_id, list_transform(range(0, 4), lambda i: embedding[i * 16 + 1 : i * 16 + 16]::DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM m WHERE vec_id = 0)
SELECT m.vec_id AS id, round(list_sum(list_transform(q.v, lambda x: list_max(list_transform(m.v, lambda y: list_dot_product(x, y))))), 6) AS score FROM m, q ORDER BY 2 DESC, 1 LIMIT 5""")
def maxsim_topk(t: Tables) -> DataFrame:
    pages = t.embeddings.select(F.col("vec_id").alias("id"), vector.slices(F.col("embedding"), 4, 16).alias("vectors"))
    first = pages.filter("id = 0").select("vectors").first()
    return rounded(search.top_k_visual(pages, [list(v) for v in first[0]], 5).select("id", "score"))


@query(f"SELECT query_id, max(score) > 0.40 AS inject, CASE WHEN max(score) > 0.40 THEN 'inject' WHEN max(score) < 0.33 THEN 'none' ELSE 'judge' END AS zone FROM ({PER_QUERY}) WHERE rank <= 5 GROUP BY 1")
def score_zones(t: Tables) -> DataFrame:
    z = search.zones(search.nearest(points(t), queries(t), 5), 0.33, 0.40)
    return z.select("query_id", (F.col("top_score") > 0.40).alias("inject"), "zone")


@query(f"SELECT query_id, 'Relevant context' || chr(10) || string_agg(printf('- v%d (%.2f): text', id, score), chr(10) ORDER BY rank) AS block FROM ({PER_QUERY}) WHERE rank <= 3 GROUP BY 1")
def context_lines(t: Tables) -> DataFrame:
    found = search.nearest(points(t), queries(t), 3).withColumn("source", F.concat(F.lit("v"), "id")).withColumn("excerpt", F.lit("text"))
    return search.context_block(found).select("query_id", F.get_json_object("block", "$.additionalContext").alias("block"))


@query(f"""
WITH h AS ({PER_QUERY}), a AS (SELECT query_id, id, score FROM h WHERE rank <= 5 AND id % 2 = 0), b AS (SELECT query_id, id, score FROM h WHERE rank <= 5 AND id % 2 = 1)
SELECT id, query_id, round(score, 4) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY score DESC, id, query_id LIMIT 10""")
def merged_collections(t: Tables) -> DataFrame:
    found = search.nearest(points(t), queries(t), 5).select("query_id", "id", "score")
    out = search.merged([found.filter("id % 2 = 0"), found.filter("id % 2 = 1")], 10)
    return out.select("id", "query_id", F.round("score", 4).alias("score"))


def related(t: Tables, of: DataFrame | None = None) -> DataFrame:
    found = search.nearest(points(t), queries(t) if of is None else of, 4)
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), (F.col("rank") - 1).alias("pos"))


#: Every document refers to two others by arithmetic on its id.
LINKS = "SELECT doc_id AS src, (doc_id * 7 + 1) % n AS dst, 0 AS pos FROM documents, (SELECT count(*) AS n FROM documents) UNION ALL SELECT doc_id, (doc_id * 13 + 5) % n, 1 FROM documents, (SELECT count(*) AS n FROM documents)"


def links(t: Tables) -> DataFrame:
    n, d = t.documents.count(), F.col("doc_id")
    make = lambda dst, pos: t.documents.select(d.alias("src"), dst.alias("dst"), F.lit(pos).alias("pos"))
    return make((d * 7 + 1) % n, 0).unionByName(make((d * 13 + 5) % n, 1))


HOPS = f"""
WITH e AS ({LINKS}), s AS (SELECT doc_id AS doc, [row_number() OVER (ORDER BY doc_id)] AS o FROM documents WHERE doc_id IN (3, 10, 17)),
r1 AS (SELECT e.dst AS doc, list_append(s.o, e.pos) AS o, s.doc AS via FROM s JOIN e ON e.src = s.doc WHERE e.dst NOT IN (SELECT doc FROM s)),
h1 AS (SELECT doc, min(o) AS o, arg_min(via, o) AS via FROM r1 GROUP BY doc),
r2 AS (SELECT e.dst AS doc, list_append(h1.o, e.pos) AS o, h1.doc AS via FROM h1 JOIN e ON e.src = h1.doc WHERE e.dst NOT IN (SELECT doc FROM s UNION ALL SELECT doc FROM h1)),
h2 AS (SELECT doc, min(o) AS o, arg_min(via, o) AS via FROM r2 GROUP BY doc)
SELECT doc, 1 AS hop, via FROM h1 UNION ALL SELECT doc, 2, via FROM h2"""


@query(HOPS)
def graph_hops(t: Tables) -> DataFrame:
    seeds = t.documents.filter(F.col("doc_id").isin(3, 10, 17)).select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("seed_no"))
    return graph.hops(links(t), seeds, 2)


@query(f"""
WITH e AS ({EVERY_EDGE}), h AS ({PER_QUERY}), s AS (SELECT query_id, id AS doc, rank AS o FROM h WHERE rank <= 3),
r AS (SELECT s.query_id, e.dst AS doc, s.o * 100 + e.pos AS o, s.doc AS via FROM s JOIN e ON e.src = s.doc)
SELECT query_id, doc, 1 AS hop, arg_min(via, o) AS via FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = r.query_id AND s.doc = r.doc) GROUP BY 1, 2""")
def search_with_hops(t: Tables) -> DataFrame:
    """One hop goes along the edges of hits only, so the related documents of other points are not looked for."""
    found = checkpoint(search.nearest(points(t), queries(t), 3))
    hits = found.select(F.col("id").alias("query_id")).distinct()
    every = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return graph.search_with_hops(found, related(t, every.join(hits, "query_id", "left_semi")), 1)


@query(f"SELECT dst, list_sort(list_distinct(list(src))) AS sources FROM ({EDGES}) GROUP BY 1")
def inverted_index(t: Tables) -> DataFrame:
    return graph.inverted(related(t))


@query(f"WITH e AS ({LINKS}) SELECT src, dst, pos FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)")
def edge_reciprocity(t: Tables) -> DataFrame:
    return graph.one_way(links(t)).select("src", "dst", "pos")


NAMES = "SELECT DISTINCT CASE doc_id % 4 WHEN 3 THEN 'loom_global' ELSE source END || CASE doc_id % 3 WHEN 0 THEN '_doc' WHEN 1 THEN '_notes' ELSE '_other' END AS name FROM documents"


def names(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(F.concat(F.when(d % 4 == 3, "loom_global").otherwise(F.col("source")), F.when(d % 3 == 0, "_doc").when(d % 3 == 1, "_notes").otherwise("_other")).alias("name")).distinct()


@query(f"SELECT name FROM ({NAMES}) WHERE regexp_matches(name, '^(\\w+)_(doc|notes|session|visual)$') AND regexp_replace(name, '_(doc|notes|session|visual)$', '') IN ('src1', 'loom_global', 'src2', 'src3')")
def scope_include(t: Tables) -> DataFrame:
    return search.permitted(names(t), "src1", "include", ["src2", "src3"])


@query(f"SELECT name FROM ({NAMES}) WHERE NOT regexp_matches(name, '^(src2|src3)_(doc|notes|session|visual)$')")
def scope_exclude(t: Tables) -> DataFrame:
    return search.permitted(names(t), "src1", "exclude", ["src2", "src3", "src1"])


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'p_notes' WHEN doc_id % 4 = 2 THEN 'p_session' ELSE 'p_doc' END AS collection FROM documents")
def route_collection(t: Tables) -> DataFrame:
    d = F.col("doc_id") % 4
    kind = F.when(d == 0, "quirk").when(d == 1, "bug-note").when(d == 2, "session").otherwise("spec")
    return t.documents.select("doc_id", search.route(kind, "p").alias("collection"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INT AS rank FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def top_per_key(t: Tables) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return t.lineitem.withColumn("rank", F.row_number().over(order)).filter("rank <= 2").select("l_orderkey", "l_linenumber", "rank")
