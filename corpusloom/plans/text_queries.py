"""Queries of text functions, ids, chunking and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, time
from ..operators import chunking, pages
from .registry import Tables, query

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
ESTIMATE = "greatest(1, floor(greatest(len(" + WORDS + ") * 1.3::DOUBLE, len({0}) / 3::DOUBLE))::INT)"
UUID = r"regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"
PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


def url_path(url) -> F.Column:
    return F.regexp_extract(url, "^[a-z]+://[^/]+/([^?#]*)", 1)


@query(f"SELECT doc_id, {ESTIMATE.format('text')} AS n FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("n"))


@query(r"SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS hash FROM documents")
def doc_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ids.file_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, {UUID.format("source || ':' || doc_id")} AS id FROM documents")
def point_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ids.point_id(F.col("source"), F.col("doc_id")).alias("id"))


@query(f"SELECT doc_id, {UUID.format("source || ':' || doc_id || ':g' || (n_chars % 5)")} AS id FROM documents")
def point_id_versioned(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ids.point_id_versioned(F.col("source"), F.col("doc_id"), F.col("n_chars") % 5).alias("id"))


@query(f"SELECT doc_id, {UUID.format("source || ':visual:' || doc_id")} AS id FROM documents")
def visual_point_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ids.visual_point_id(F.col("source"), F.col("doc_id")).alias("id"))


BASE = "regexp_extract(url, '([^/]*)$', 1)"
STEM = f"regexp_replace({BASE}, '^(.+)\\.[^.]*$', '\\1')"


@query(f"SELECT page_id, lower(regexp_replace(regexp_replace({STEM}, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM pages")
def slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.slug(F.col("url")).alias("slug"))


@query(f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'datasheet' WHEN 1 THEN 'unknown' WHEN 2 THEN 'guide' ELSE 'spec' END AS doc_type,
  CASE WHEN lower(path) LIKE '%.md' THEN 'markdown' ELSE 'pdf' END AS file_type,
  '.loom/sidecars/' || regexp_replace(path, '^(.*[^/])\\.[^./]+$', '\\1') || '.embed-meta.yaml' AS sidecar_path
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'datasheets/' WHEN 1 THEN 'other/' WHEN 2 THEN 'specs/guides/x/' ELSE 'specs/' END || {PATH} AS path FROM pages)""")
def file_attributes(t: Tables) -> DataFrame:
    folder = F.when(F.col("page_id") % 4 == 0, "datasheets/").when(F.col("page_id") % 4 == 1, "other/").when(F.col("page_id") % 4 == 2, "specs/guides/x/").otherwise("specs/")
    path = F.concat(folder, url_path("url"))
    return t.pages.select("page_id", text.doc_type(path).alias("doc_type"), text.file_type(path).alias("file_type"), text.sidecar_path(path, ".loom/sidecars").alias("sidecar_path"))


@query("SELECT doc_id, substr(text, 1, 300) AS excerpt, substr(text, 1, 100) AS preview, right(text, 500) AS query FROM documents")
def excerpts(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.left(x, F.lit(300)).alias("excerpt"), F.left(x, F.lit(100)).alias("preview"), text.query_of(x).alias("query"))


@query(f"""
SELECT page_id FROM (SELECT page_id, {PATH} AS path FROM pages)
WHERE NOT (starts_with(path, 'en/') OR contains('/' || path, '/en/') OR regexp_extract(path, '([^/]*)$', 1) LIKE '1%.html' OR path LIKE '1%.html' OR path LIKE 'de/2%')""")
def exclude_globs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url_path("url").alias("path")).filter(~text.excluded(F.col("path"), ["en/", "1*.html", "de/2*"])).select("page_id")


@query("SELECT doc_id, regexp_matches(marked, '(?i)\\b(fig\\.?|figure|plot|chart|diagram|graph)\\s*\\d+\\b') AS caption FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' see Figure 12.' WHEN 1 THEN ' figment of 3' ELSE ' FIG. 1' END AS marked FROM documents)")
def captions(t: Tables) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, " see Figure 12.").when(F.col("doc_id") % 3 == 1, " figment of 3").otherwise(" FIG. 1")
    return t.documents.select("doc_id", text.has_caption(F.concat("text", end)).alias("caption"))


@query("""
SELECT doc_id, CASE WHEN n_chars < 150 THEN 'flattened' WHEN doc_id % 7 = 0 THEN 'structured_text' WHEN doc_id % 5 = 0 OR (doc_id % 3 = 0 AND n_chars < 600) THEN 'text_with_images' ELSE 'pure_text' END AS page_class
FROM documents""")
def page_class(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select("doc_id", pages.page_class(F.col("n_chars"), d % 5 == 0, d % 7 == 0, d % 3 == 0).alias("page_class"))


@query("""
WITH e AS (SELECT user_id, value AS x, lag(value) OVER w AS p FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value)),
g AS (SELECT user_id, x, sum(CASE WHEN p IS NULL OR x - p >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM e),
s AS (SELECT user_id, c, count(*) AS n FROM g GROUP BY 1, 2)
SELECT user_id, sum(n) >= 4 AND count(*) FILTER (n >= 2) >= 2 AS aligned FROM s GROUP BY 1""")
def cluster_columns(t: Tables) -> DataFrame:
    rows = t.events.filter("value IS NOT NULL").groupBy("user_id").agg(F.collect_list("value").alias("x"))
    return rows.select("user_id", pages.columns_aligned(F.col("x")).alias("aligned"))


@query(f"""
SELECT doc_id, (u.i - 1)::INT AS part, u.p AS text FROM (
  SELECT doc_id, CASE WHEN {ESTIMATE.format('text')} <= 200 THEN [text]
    ELSE list_transform(range(0, len(w), 153), lambda i: array_to_string(w[i + 1 : i + 153], ' ')) END AS parts
  FROM (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents)
), LATERAL (SELECT unnest(parts) AS p, generate_subscripts(parts, 1) AS i) u""")
def split_vision_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(chunking.split_windows(F.col("text"), 200)).alias("part", "text"))


@query("""
WITH parts AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## ') AS p FROM documents),
rows AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS page FROM parts)
SELECT doc_id, page::INT AS page, length(CASE WHEN page = 1 THEN trim(raw, ' ' || chr(9) || chr(10)) ELSE rtrim('## ' || raw, ' ' || chr(9) || chr(10)) || chr(10) || 'body' END)::INT AS n
FROM rows WHERE page > 1 OR trim(raw, ' ' || chr(9) || chr(10)) <> ''""")
def section_split(t: Tables) -> DataFrame:
    """Every line but the first is made a heading with a body."""
    from ..sources.corpus import sections

    lines = F.split("text", "\n")
    made = F.concat(lines[0], F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda s: F.concat(F.lit("\n## "), s)), ""))
    body = F.concat_ws("\n", F.transform(F.split(made, "\n(?=## )"), lambda s: F.when(s.startswith("## "), F.concat(F.rtrim(s), F.lit("\nbody"))).otherwise(s)))
    out = sections(t.documents.select(F.col("doc_id").alias("path"), body.alias("text")))
    return out.select(F.col("path").alias("doc_id"), "page", F.length("text").alias("n"))


@query("SELECT doc_id, 'title: ' || source AS block, text AS body FROM documents")
def frontmatter_extract(t: Tables) -> DataFrame:
    from ..sources.corpus import frontmatter_block, strip_frontmatter

    made = F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n"), "text")
    return t.documents.select("doc_id", F.trim(F.replace(frontmatter_block(made), F.lit("\n"), F.lit(""))).alias("block"), strip_frontmatter(made).alias("body"))


@query("""
SELECT doc_id, 2 AS n_tables, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || source || ' | ' || lang || ' |' AS first_table FROM documents""")
def table_extract(t: Tables) -> DataFrame:
    table = F.concat(F.lit("| a | b |\n|---|---|\n| "), "source", F.lit(" | "), "lang", F.lit(" |\n"))
    plain = F.translate("text", "|", "")
    found = text.tables(F.concat(plain, F.lit("\n"), table, F.lit("\n"), plain, F.lit("\n"), table))
    return t.documents.select("doc_id", F.size(found).alias("n_tables"), found[0].alias("first_table"))


@query("""
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, CASE WHEN max(l_returnflag) = 'R' THEN 'table' ELSE 'text' END AS kind, max(l_quantity)::INT AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN kind = 'table' OR coalesce(lag(kind) OVER w, 'table') = 'table' OR n >= 25 THEN 1 ELSE 0 END AS s FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1)::INT AS chunk_index, string_agg('line ' || i, chr(10) || chr(10) ORDER BY i) AS text, max(kind) AS chunk_type, max(i)::INT AS page, sum(n)::INT AS tokens FROM g GROUP BY doc_id, run""")
def merge_small_chunks(t: Tables) -> DataFrame:
    c = F.col
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_quantity").alias("l_quantity"))
    rows = lines.select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("chunk_index"), F.when(c("l_returnflag") == "R", "table").otherwise("text").alias("chunk_type"), F.concat(F.lit("line "), "l_linenumber").alias("text"), c("l_linenumber").alias("page"), F.lit("").alias("heading"), c("l_quantity").cast("int").alias("estimated_tokens"))
    return chunking.merge_small(rows, 25).select("doc_id", "chunk_index", "text", "chunk_type", "page", c("estimated_tokens").alias("tokens"))


@query()
def chunk_text(t: Tables) -> DataFrame:
    given = t.documents.select("doc_id", F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.array(F.lit("Introduction")).alias("headings"))
    return chunking.chunk_text(given)


@query()
def chunk_transcript(t: Tables) -> DataFrame:
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    talks = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    return chunking.by_document(talks, chunking.chunk_transcript, "chunk_index int, chunk string", key="conv_id")


@query()
def chunk_plain(t: Tables) -> DataFrame:
    given = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.by_document(given, lambda x: list(enumerate(chunking.chunk_plain(x, 400, 60))), "chunk_index int, chunk string")


@query()
def chunk_structured(t: Tables) -> DataFrame:
    table = F.concat(F.lit("\n| a | b |\n|---|---|\n| "), "source", F.lit(" | x |\n"))
    return chunking.ocr_chunks(t.documents.select("doc_id", F.concat("text", table, F.lit("\n"), "text").alias("text")), 400)


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM p),
r AS (SELECT l_orderkey, min(n) AS lo, max(n) AS hi FROM i GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY 1""")
def page_ranges(t: Tables) -> DataFrame:
    return pages.page_ranges(t.lineitem, ["l_orderkey"], "l_linenumber")


@query("""
SELECT doc_id, page, xref, w, h FROM (
  SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS xref, w, h, row_number() OVER (PARTITION BY l_orderkey ORDER BY w * h DESC, l_linenumber) AS r
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS w, max(l_suppkey) AS h FROM lineitem GROUP BY 1, 2)) WHERE r <= 4""")
def largest_images(t: Tables) -> DataFrame:
    c = F.col
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("w"), F.max("l_suppkey").alias("h"))
    rows = lines.select(c("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), c("l_linenumber").alias("xref"), "w", "h")
    return pages.largest_images(rows)


@query("""
SELECT user_id AS doc_id, count(DISTINCT event_id % 7) AS pages_analyzed, count(DISTINCT event_id % 7) FILTER (event_type = 'click') AS ocr_pages,
  count(DISTINCT event_id % 7) FILTER (event_type <> 'click') AS vision_pages, sum(length(props))::BIGINT AS char_count FROM events GROUP BY 1""")
def vision_metadata(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("page"), F.when(F.col("event_type") == "click", "ocr").otherwise("vision").alias("model"), F.lit("pure_text").alias("page_class"), F.col("props").alias("text"))
    return pages.vision_summary(e).drop("page_details")


@query("SELECT event_id, (value > 50) AS over, greatest(0, floor((epoch_us(TIMESTAMP '2100-01-01') - epoch_us(ts)) / 86400000000.0))::INT AS days, floor(epoch(ts))::BIGINT AS epoch FROM events")
def event_ages(t: Tables) -> DataFrame:
    now = F.lit("2100-01-01").cast("timestamp")
    return t.events.select("event_id", (F.col("value") > 50).alias("over"), time.days_between(now, F.col("ts").cast("timestamp")).alias("days"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))


@query("SELECT page_id, to_base64(encode(html)) AS image FROM pages")
def base64_content(t: Tables) -> DataFrame:
    from ..sources.corpus import base64_images

    out = base64_images(t.pages.select(F.col("page_id").alias("path"), F.encode("html", "utf-8").alias("content")))
    return out.select(F.col("path").alias("page_id"), F.regexp_replace("image", r"\s", "").alias("image"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licen') OR contains(lower(text), 'password')")
def keyword_fallback(t: Tables) -> DataFrame:
    return t.documents.filter(text.mentions(F.col("text"), ["licen", "PASSWORD"])).select("doc_id")
