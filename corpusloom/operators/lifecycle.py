"""Keyed state over snapshots: upserts, staleness, generations, expiry, issue history. Each gives the next state."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, time
from ..session import checkpoint


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The state with the last change of each key in place of its row."""
    new = latest(changes, keys, order)
    return state.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*state.columns))


def merge_update(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The state with the non-null fields of one update a key; keys that are new are added."""
    fields = [c for c in state.columns if c != key]
    new = updates.select(key, *(F.col(c).alias(f"_{c}") for c in fields if c in updates.columns))
    both = state.join(new, key, "full_outer")
    return both.select(key, *((F.coalesce(f"_{c}", c) if f"_{c}" in new.columns else F.col(c)).alias(c) for c in fields))


def needs_rehash(recorded: Column, actual: Column) -> Column:
    """Nothing is recorded, or another modification time."""
    return recorded.isNull() | (recorded != actual)


def detect_changes(state: DataFrame, snapshot: DataFrame, key: str = "path") -> DataFrame:
    """Each file (key, mtime, hash) against its state (key, file_mtime, file_hash, generation): what is to be done.

    skip_mtime: same time; skip_hash: same content; reembed: other content, one generation on; new: no state.
    """
    both = snapshot.join(state.select(key, "file_mtime", "file_hash", "generation"), key, "left")
    action = F.when(F.col("generation").isNull() & F.col("file_hash").isNull(), "new").when(~needs_rehash(F.col("file_mtime"), F.col("mtime")), "skip_mtime").when(F.col("file_hash") == F.col("hash"), "skip_hash").otherwise("reembed")
    return both.select(key, action.alias("action"), F.when(action == "reembed", F.coalesce("generation", F.lit(1)) + 1).otherwise(F.coalesce("generation", F.lit(1))).alias("generation"))


def with_version(history: Column, hash_: Column, generation: Column, at: Column, most: int = 2) -> Column:
    """A version history with one more entry, cut to the last ones."""
    longer = F.concat(F.coalesce(history, F.array().cast("array<struct<hash:string,generation:int,indexed_at:string>>")), F.array(F.struct(hash_.alias("hash"), generation.cast("int").alias("generation"), at.cast("string").alias("indexed_at"))))
    return F.slice(longer, F.greatest(F.size(longer) - most + 1, F.lit(1)), F.lit(most))


def last_versions(rows: DataFrame, keys: list[str], order: list[Column], most: int = 2) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def mark_stale(points: DataFrame, stale: DataFrame, now: Column) -> DataFrame:
    """Points of the given sidecar_ids get stale_as_of and a status; points without an id never do."""
    ids = stale.filter(F.coalesce("sidecar_id", F.lit("")) != "").select("sidecar_id").distinct().withColumn("_stale", F.lit(True))
    both = points.join(ids, "sidecar_id", "left")
    hit = F.col("_stale").isNotNull()
    return both.withColumn("stale_as_of", F.when(hit, now).otherwise(F.col("stale_as_of"))).withColumn("status", F.when(hit, "stale").otherwise(F.col("status"))).select(*points.columns)


def expire(points: DataFrame, now: Column, days: int) -> DataFrame:
    """Points without those orphaned longer ago than so many days; points without a sidecar_id stay."""
    return points.filter(~(time.expired(F.col("orphaned_at"), now, days) & (F.coalesce("sidecar_id", F.lit("")) != "")))


def stale_alert(sidecars: DataFrame, least: float = 0.30) -> DataFrame:
    """One row: stale and all metadata, and a message if the share reaches a threshold."""
    counts = sidecars.agg(F.count_if(F.col("status") == "stale").alias("stale"), F.count(F.lit(1)).alias("total"))
    share = F.col("stale") / F.nullif(F.col("total"), F.lit(0))
    return counts.withColumn("message", F.when(share >= least, F.format_string("%d of %d (%d%%) are stale", "stale", "total", time.truncated_percent(F.col("stale"), F.col("total")))))


def induct(files: DataFrame, sidecars: DataFrame, project: str, docs_root: str = "docs/") -> DataFrame:
    """Stubs for markdown and PDF files under the documents' folder that have no metadata."""
    path = F.col("path")
    new = files.filter(path.startswith(docs_root) & text.suffix(path).isin(".md", ".pdf")).join(sidecars.select(F.col("current_path").alias("path")).distinct(), "path", "left_anti")
    kind = text.doc_type(path)
    return new.select(text.sidecar_path(path, ".loom/sidecars").alias("sidecar_path"), text.slug(path).alias("slug"), kind.alias("doc_type"), text.file_type(path).alias("file_type"), path.alias("current_path"), F.lit("pending").alias("status"), F.lit(f"{project}_doc").alias("collection"), F.lit(1).alias("generation"), F.sha2(path, 256).alias("sidecar_id"))


def heal(sidecars: DataFrame, files: DataFrame, root: str = ".loom/sidecars/") -> DataFrame:
    """Missing source paths filled in from files of the same place and stem: PDF first, then markdown."""
    base = F.regexp_replace(F.substring("sidecar_path", len(root) + 1, 1 << 20), r"\.embed-meta\.yaml$", "")
    rank = F.when(text.suffix(F.col("path")) == ".pdf", 1).when(text.suffix(F.col("path")) == ".md", 2)
    found = files.withColumn("_rank", rank).filter("_rank IS NOT NULL").groupBy(F.regexp_replace("path", r"\.[^./]+$", "").alias("_base")).agg(F.min_by("path", "_rank").alias("_path"))
    both = sidecars.withColumn("_base", base).join(found, "_base", "left")
    return both.withColumn("current_path", F.coalesce(F.nullif("current_path", F.lit("")), "_path")).select(*sidecars.columns)


def migrate(sidecars: DataFrame, root: str = ".loom/sidecars/") -> DataFrame:
    """Metadata beside their sources get the mirrored path; what is already there wins."""
    moved = sidecars.withColumn("_old", ~F.col("sidecar_path").startswith(root)).withColumn("sidecar_path", F.when(F.col("sidecar_path").startswith(root), F.col("sidecar_path")).otherwise(F.concat(F.lit(root), "sidecar_path")))
    return latest(moved, ["sidecar_path"], [F.col("_old")]).drop("_old")


def orphaned(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata whose source file is gone."""
    return sidecars.filter(F.coalesce("current_path", F.lit("")) != "").join(files.select(F.col("path").alias("current_path")).distinct(), "current_path", "left_anti")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts of (outcome)."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("embedded", "skipped", "error")))


def chunk_totals(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text and image chunks of each document."""
    return chunks.groupBy(key).agg(F.count_if(F.col("kind") == "text").alias("text_chunks"), F.count_if(F.col("kind") == "image").alias("image_chunks"), F.count(F.lit(1)).alias("chunk_count"))


def issue_history(before: DataFrame, now: DataFrame) -> DataFrame:
    """Issues (id, doc, type, state) carried on by (doc, type): new, persisting, resolved, archived.

    An issue that was resolved and comes back is new again under its old id; resolved ones that stay away are archived.
    Ids of new issues go on from the largest there is and are never used again.
    """
    seen = now.select("doc", "type").distinct().withColumn("_now", F.lit(True))
    both = before.join(seen, ["doc", "type"], "full_outer")
    live = ~F.coalesce(F.col("state").isin("resolved", "archived"), F.lit(False))
    state = F.when(F.col("id").isNull(), "new").when(F.col("_now") & live, "persisting").when(F.col("_now"), "new").when(F.col("state").isin("resolved", "archived"), "archived").otherwise("resolved")
    both = both.withColumn("state", state)
    # new issues are numbered in one order: by ranges, whose sizes (one row each) give each range its first number
    fresh = checkpoint(both.filter("id IS NULL").drop("id").repartitionByRange("doc", "type").withColumn("_b", F.spark_partition_id()))
    sizes = {r["_b"]: r["n"] for r in fresh.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = dict(zip(sorted(sizes), accumulate((sizes[b] for b in sorted(sizes)), initial=before.agg(F.max("id")).first()[0] or 0)))
    begin = F.create_map(*[F.lit(x).cast("long") for kv in first.items() for x in kv]) if first else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    fresh = fresh.withColumn("id", begin[F.col("_b").cast("long")] + F.row_number().over(Window.partitionBy("_b").orderBy("doc", "type")))
    return both.filter("id IS NOT NULL").select("id", "doc", "type", "state").unionByName(fresh.select("id", "doc", "type", "state"))
