"""Consistency of three stores: source files, metadata (registry), stored chunks (index by sidecar_id)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, time
from ..sources import corpus
from .checks import all_issues


def _issue(prefix: str, category: str, severity: str, key: str, *more: Column | str) -> list[Column]:
    return [ids.issue_id(prefix, F.col(key)).alias("id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), *(F.col(c) if isinstance(c, str) else c for c in more)]


def _by_path(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata with its file. Hashes and paths compress well, so that parts of equal bytes would be many rows: they are dealt by rows."""
    n = corpus.parts_of(corpus.FILE_ROWS, registry, files)
    return corpus.dealt(registry, "file_path", n).join(corpus.dealt(files, "file_path", n), "file_path")


def _without(rows: DataFrame, others: DataFrame, key: str, *sizes: DataFrame) -> DataFrame:
    """Rows whose key the others lack, both dealt into parts by the rows of the largest of some tables."""
    return rows.join(corpus.dealt(others.select(key), key, corpus.parts_of(corpus.FILE_ROWS, *sizes)), key, "left_anti")


def orphaned_chunks(index: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks whose sidecar_id no metadata has."""
    out = _without(index, registry, "sidecar_id", registry)
    preview = F.left(F.coalesce("first_text", F.lit("")), F.lit(100)).alias("first_chunk_text")
    return out.select(*_issue("orphaned", "orphaned_chunks", "warning", "sidecar_id", "sidecar_id", "chunk_ids", F.col("chunk_count").cast("long").alias("chunk_count"), preview, F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")))


def missing_sidecars(index: DataFrame, registry: DataFrame, root: str = ".loom/sidecars/") -> DataFrame:
    """The same chunks seen from the metadata that should be there."""
    out = _without(index, registry, "sidecar_id", registry)
    want = F.coalesce(F.concat(F.lit(root), F.col("file_path"), F.lit(".embed-meta.yaml")), F.lit("unknown")).alias("expected_sidecar_path")
    return out.select(*_issue("missing_sidecar", "missing_sidecars", "warning", "sidecar_id", "sidecar_id", "file_path", F.col("chunk_count").cast("long").alias("chunk_count"), want))


def stale_sidecars(registry: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Files modified after the recorded time; whole days since embedding (or the recorded time)."""
    both = _by_path(registry.filter("file_path IS NOT NULL AND file_mtime IS NOT NULL"), files.select(F.col("path").alias("file_path"), "mtime")).filter("mtime > file_mtime")
    since = F.coalesce(F.try_to_timestamp("last_embedded"), time.from_epoch(F.col("file_mtime")))
    return both.select(*_issue("stale", "stale_sidecars", "info", "sidecar_id", "sidecar_id", "file_path", "sidecar_path", "last_embedded", time.iso(time.from_epoch(F.col("mtime"))).alias("file_modified"), time.days_between(now, since).alias("days_stale")))


def hash_mismatches(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path, hash) whose content differs from the recorded hash."""
    both = _by_path(registry.filter("file_path IS NOT NULL AND file_hash IS NOT NULL"), files.select(F.col("path").alias("file_path"), F.col("hash").alias("actual_hash"))).filter("actual_hash <> file_hash")
    return both.select(*_issue("hash_mismatch", "hash_mismatches", "warning", "sidecar_id", "sidecar_id", "file_path", "sidecar_path", F.col("file_hash").alias("recorded_hash"), "actual_hash"))


def disconnected_files(files: DataFrame, registry: DataFrame, index: DataFrame, docs_root: str = "docs/", excluded: Iterable[str] = ()) -> DataFrame:
    """Markdown and PDF files under the documents' folder that neither metadata nor chunks cover."""
    path = F.col("path")
    candidates = files.filter(path.startswith(docs_root) & (path.endswith(".md") | path.endswith(".pdf")) & ~text.excluded_inside(path, list(excluded)))
    covered = registry.select(F.col("file_path").alias("path")).union(index.select(F.col("file_path").alias("path"))).filter("path IS NOT NULL")
    out = _without(candidates, covered, "path", files, registry).withColumn("_stem", text.stem(path))
    return out.select(*_issue("disconnected", "disconnected_files", "info", "_stem", F.col("path").alias("file_path"), F.lit("no sidecar and no chunks").alias("reason")))


def count_mismatches(registry: DataFrame, index: DataFrame) -> DataFrame:
    """Recorded and stored numbers of chunks that differ (none stored: 0)."""
    stored = index.select("sidecar_id", F.col("chunk_count").cast("long").alias("actual_chunk_count"), "chunk_ids")
    both = registry.filter("chunk_count IS NOT NULL").select("sidecar_id", F.col("chunk_count").cast("long").alias("recorded_chunk_count")).join(stored, "sidecar_id", "left")
    both = both.withColumn("actual_chunk_count", F.coalesce("actual_chunk_count", F.lit(0).cast("long"))).filter("actual_chunk_count <> recorded_chunk_count")
    return both.select(*_issue("mismatch", "qdrant_sidecar_mismatches", "error", "sidecar_id", "sidecar_id", "recorded_chunk_count", "actual_chunk_count", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")))


def missing_sources(sidecars: DataFrame, files: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """Metadata whose source file is gone."""
    rows = sidecars.filter(F.coalesce("current_path", F.lit("")) != "").filter(~text.excluded_inside(F.col("sidecar_path"), list(excluded)))
    out = _without(rows, files.select(F.col("path").alias("current_path")), "current_path", files, sidecars).withColumn("_stem", F.regexp_replace(text.basename(F.col("sidecar_path")), r"\.embed-meta\.yaml$", ""))
    return out.select(*_issue("missing_source", "missing_source_sidecars", "warning", "_stem", "sidecar_path", F.col("current_path").alias("missing_source")))


def by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def audit(files: DataFrame, sidecars: DataFrame, registry: DataFrame, index: DataFrame, now: Column, docs_root: str = "docs/", excluded: Iterable[str] = ()) -> DataFrame:
    """All seven detectors. files: path, mtime, hash."""
    return all_issues([
        orphaned_chunks(index, registry), missing_sidecars(index, registry), stale_sidecars(registry, files, now), hash_mismatches(registry, files),
        disconnected_files(files, registry, index, docs_root, excluded), count_mismatches(registry, index), missing_sources(sidecars, files, excluded),
    ])
