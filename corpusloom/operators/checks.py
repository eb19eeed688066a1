"""Structural checks of a corpus. Each gives issues: type, severity, doc, detail, and fields of its own."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, time

#: Names that may lie outside the documents' folder.
AT_ROOT = ("README.md", "CHANGELOG.md", "CONTRIBUTING.md", "LICENSE.md", "CLAUDE.md", "AGENTS.md", "GEMINI.md", ".cursorrules", "CODEOWNERS")
SEVERITIES = ("error", "warning", "info")


def issue(kind: str, severity: str, doc: Column | str, detail: Column | str, **more: Column) -> list[Column]:
    doc = F.col(doc) if isinstance(doc, str) else doc
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return [F.lit(kind).alias("type"), F.lit(severity).alias("severity"), doc.alias("doc"), detail.alias("detail"), *(c.alias(n) for n, c in more.items())]


def all_issues(found: Iterable[DataFrame]) -> DataFrame:
    """One table of all checks' issues."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def homeless(docs: DataFrame, docs_root: str = "docs/", anchors: Iterable[str] = (), excluded: Iterable[str] = ()) -> DataFrame:
    """Markdown outside the documents' folder under a name that isn't expected there."""
    path = F.col("path")
    names = [*AT_ROOT, *(a.rsplit("/", 1)[-1] for a in anchors)]
    out = docs.filter(path.endswith(".md") & ~path.startswith(docs_root) & ~text.basename(path).isin(names) & ~text.excluded(path, list(excluded)))
    return out.select(*issue("homeless_doc", "warning", "path", f"outside {docs_root}"))


def missing_frontmatter(docs: DataFrame) -> DataFrame:
    return docs.filter("frontmatter IS NULL").select(*issue("missing_frontmatter", "info", "path", "no frontmatter"))


def prototypes(docs: DataFrame) -> DataFrame:
    return docs.filter("frontmatter.status = 'prototype'").select(*issue("prototype_doc", "info", "path", "status is prototype"))


def stale_reviews(docs: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Reviewed more than so many days ago; prototypes, archived documents and dates that can't be read are passed over."""
    age = F.datediff(today, time.iso_date(F.col("frontmatter.last_reviewed")))
    live = ~F.coalesce(F.col("frontmatter.status").isin("prototype", "archived"), F.lit(False))
    return docs.filter(live & (age > days)).select(*issue("stale_last_reviewed", "warning", "path", F.format_string("reviewed %d days ago", age)))


def broken_related(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Related entries that name no file."""
    out = edges.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_anti")
    return out.select(*issue("broken_related", "error", "src", F.concat(F.lit("missing: "), F.col("dst")), related_file=F.col("dst")))


def one_way_links(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries whose target has frontmatter but no entry back. Each occurrence is an issue."""
    known = docs.filter("frontmatter IS NOT NULL").select(F.col("path").alias("dst")).distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    out = edges.join(known, "dst", "left_semi").join(back, ["src", "dst"], "left_anti")
    return out.select(*issue("one_way_link", "warning", "src", F.concat(F.lit("not linked from "), F.col("dst")), related_file=F.col("dst")))


def drifted_related(edges: DataFrame, docs: DataFrame, commits: DataFrame) -> DataFrame:
    """Related files committed after the document's review."""
    live = ~F.coalesce(F.col("frontmatter.status").isin("prototype", "archived"), F.lit(False))
    seen = docs.filter(live).select(F.col("path").alias("src"), time.iso_date(F.col("frontmatter.last_reviewed")).alias("_seen"))
    out = edges.join(seen, "src").join(commits.select(F.col("path").alias("dst"), "last_commit"), "dst").filter("last_commit > _seen")
    return out.select(*issue("stale_related", "warning", "src", F.concat(F.lit("newer: "), F.col("dst")), related_file=F.col("dst")))


def orphans(docs: DataFrame, edges: DataFrame, siblings: DataFrame) -> DataFrame:
    """Documents that none refers to and that are the only markdown file of their folder. siblings: all files (path)."""
    alone = siblings.filter(F.col("path").endswith(".md")).groupBy(text.parent(F.col("path")).alias("_dir")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    out = docs.join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti").withColumn("_dir", text.parent(F.col("path"))).join(alone, "_dir", "left_semi")
    return out.select(*issue("orphaned_doc", "info", "path", "no links to it and no siblings"))


def nested_docs(files: DataFrame, docs_root: str = "docs", excluded: Iterable[str] = ()) -> DataFrame:
    """Folders named as the documents' folder below others."""
    parts = F.split(text.parent(F.col("path")), "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folder = files.select(F.explode(upto).alias("dir")).distinct()
    name = docs_root.strip("/")
    out = folder.filter((text.basename(F.col("dir")) == name) & (F.col("dir") != name) & ~F.concat(F.lit("/"), "dir", F.lit("/")).contains("/.git/"))
    out = out.filter(~text.excluded(F.concat("dir", F.lit("/")), list(excluded)))
    return out.select(*issue("nested_docs_folder", "warning", "dir", "nested documents folder"))


def sidecar_paths(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata without a source path, or whose source is gone."""
    there = files.select(F.col("path").alias("_there")).distinct()
    out = sidecars.filter("NOT failed").join(there, F.col("current_path") == F.col("_there"), "left").filter("_there IS NULL")
    missing = F.coalesce("current_path", F.lit("")) == ""
    return out.select(F.when(missing, "sidecar_missing_path").otherwise("sidecar_path_drift").alias("type"), F.when(missing, "info").otherwise("warning").alias("severity"),
                      F.col("sidecar_path").alias("doc"), F.when(missing, "no current_path").otherwise(F.concat(F.lit("missing: "), F.col("current_path"))).alias("detail"), F.col("current_path").alias("expected_path"))


def sidecar_errors(sidecars: DataFrame) -> DataFrame:
    return sidecars.filter("failed").select(*issue("sidecar_parse_error", "error", "sidecar_path", "can't be parsed"))


def sidecar_broken_related(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    out = sidecars.select("sidecar_path", F.explode("related_docs").alias("dst")).join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_anti")
    return out.select(*issue("sidecar_broken_related", "error", "sidecar_path", F.concat(F.lit("missing: "), F.col("dst")), related_file=F.col("dst")))


def induction_needed(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files without metadata, or whose metadata is pending."""
    state = sidecars.select(F.col("current_path").alias("path"), "status")
    out = media.select("path").join(state, "path", "left").filter("status IS NULL OR status = 'pending'")
    return out.select(*issue("embed_induction_needed", "warning", "path", F.when(F.col("status").isNull(), "no sidecar").otherwise("sidecar is pending")))


def embed_drift(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files modified after they were embedded."""
    out = sidecars.filter("status = 'embedded' AND file_mtime IS NOT NULL").join(files.select(F.col("path").alias("current_path"), "mtime"), "current_path").filter("mtime > file_mtime")
    return out.select(*issue("embed_drift", "warning", "current_path", "modified after embedding"))


def lfs_not_pulled(media: DataFrame) -> DataFrame:
    from ..sources.corpus import lfs_pointers

    return lfs_pointers(media).select(*issue("embed_lfs_not_pulled", "info", "path", "large-file pointer"))


def unprocessed_transcripts(transcripts: DataFrame, files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Transcripts (path) without a summary file of their stem and not integrated or fulfilled by their metadata."""
    stem = transcripts.select("path", text.stem(F.col("path")).alias("_stem"))
    summary = files.filter(F.col("path").endswith("-summary.md")).select(F.regexp_replace(text.basename(F.col("path")), r"-summary\.md$", "").alias("_stem")).distinct()
    done = sidecars.filter(F.col("status").isin("integrated", "fulfilled")).select(F.col("current_path").alias("path")).distinct()
    return stem.join(summary, "_stem", "left_anti").join(done, "path", "left_anti").select(*issue("transcript_unprocessed", "warning", "path", "no summary"))


def by_severity(issues: DataFrame) -> DataFrame:
    """Issues of each severity, with zeros."""
    every = issues.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def statistics(docs: DataFrame, sidecars: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: documents, with frontmatter, with an id, by status; metadata files; homeless documents."""
    of = lambda s: F.count_if(F.col("frontmatter.status") == s)
    doc = docs.agg(F.count(F.lit(1)).alias("total_docs"), F.count_if(F.col("frontmatter").isNotNull()).alias("with_frontmatter"), F.count_if(F.col("frontmatter.id").isNotNull()).alias("with_id"), of("active").alias("active"), of("prototype").alias("prototype"), of("archived").alias("archived"))
    side, out = sidecars.agg(F.count(F.lit(1)).alias("sidecars")), issues.agg(F.count_if(F.col("type") == "homeless_doc").alias("homeless"))
    return doc.join(F.broadcast(side)).join(F.broadcast(out))  # three tables of one row


def scan(docs: DataFrame, files: DataFrame, sidecars: DataFrame, commits: DataFrame, today: Column, *, docs_root: str = "docs/", anchors: Iterable[str] = (), excluded: Iterable[str] = (), stale_days: int = 30) -> DataFrame:
    """All checks over documents (path, frontmatter), files (path, mtime), metadata and commits (path, last_commit)."""
    from ..sources.corpus import edges as related

    tracked = docs.filter(F.col("path").startswith(docs_root)).filter(~text.excluded(F.col("path"), list(excluded)))
    links = related(tracked)
    return all_issues([
        homeless(docs, docs_root, anchors, excluded), nested_docs(files, docs_root, excluded), missing_frontmatter(tracked), prototypes(tracked), stale_reviews(tracked, today, stale_days),
        broken_related(links, files), one_way_links(links, tracked), drifted_related(links, tracked, commits), orphans(tracked, links, files),
        sidecar_errors(sidecars), sidecar_paths(sidecars, files), sidecar_broken_related(sidecars.filter("NOT failed"), files), embed_drift(files, sidecars),
    ])


def write_scan(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").json(path)


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def missing_names(expected: DataFrame, *there: DataFrame, name: str = "name") -> DataFrame:
    """Expected names that are in none of the other tables."""
    for found in there:
        expected = expected.join(found.select(name), name, "left_anti")
    return expected.select(name)


def unlisted(lines: Column, entries: Column, parents: Column) -> Column:
    """The entries that are not among the lines of an ignore file; none where a line covers their folder."""
    return F.when(F.arrays_overlap(lines, parents), F.array().cast("array<string>")).otherwise(F.array_except(entries, lines))
