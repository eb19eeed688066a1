"""Reading a repository of documents: files, frontmatter, metadata files, stored points and commit logs.

Paths come out relative to the root. Reading is distributed; nothing is listed on the driver.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable, Iterator, Mapping
from pathlib import PurePosixPath
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, text

FRONTMATTER = "struct<related:array<string>,last_reviewed:string,status:string,id:string,other:map<string,string>>"
SIDECAR = (
    "sidecar_id string, slug string, doc_type string, file_type string, current_path string, status string, indexed_at string, chunk_count int, "
    "image_count int, file_mtime double, collection string, file_hash string, hash_algorithm string, generation int, last_embedded string, "
    "last_hash_check_at string, related_docs array<string>, version_history array<struct<hash:string,generation:int,indexed_at:string>>"
)
#: Files that can be embedded besides markdown.
MEDIA = (".pdf", ".m4a", ".mp3", ".wav", ".aac")
#: The project that global collections belong to; settable for stores that name it otherwise.
GLOBAL = "loom_global"
#: Fixed pattern of collection names.
COLLECTION = rf"(?U)^((\w+)_(doc|notes|session|visual)|{GLOBAL}_(doc|notes|session|visual))$"

#: Stored points, and files or metadata (of which each has several points), that one task sorts or hashes.
POINT_ROWS, FILE_ROWS = 1_000_000, 300_000



def relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, r"^[a-z][a-z0-9+.-]*:/*(?=/)", "")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.substring(plain, len(base) + 1, 1 << 20)


def files(spark: SparkSession, root: str, pattern: str = "*", content: bool = True, inside: str = "") -> DataFrame:
    """path, mtime (seconds), length and content of all files under root that match a name pattern, but .git's.

    Spark passes over folders whose names begin with a dot unless they are named: inside is one below root.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(f"{root.rstrip('/')}/{inside}")
    found = found.select(relative(F.col("path"), root).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length", *(["content"] if content else []))
    return found.filter(~F.concat(F.lit("/"), "path").contains("/.git/"))


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime and text of all markdown files."""
    return files(spark, root, "*.md").select("path", "mtime", F.decode("content", "utf-8").alias("text"))


def tracked(docs: DataFrame, docs_root: str = "docs/", excluded: Iterable[str] = ()) -> DataFrame:
    """The documents under docs_root that no exclusion pattern matches."""
    return docs.filter(F.col("path").startswith(docs_root)).filter(~text.excluded(F.col("path"), list(excluded)))


def media(found: DataFrame, folders: Iterable[str]) -> DataFrame:
    """Files in the folders to be scanned whose kind can be embedded; names with a leading dot are skipped."""
    inside = text.any_of([F.col("path").startswith(f.rstrip("/") + "/") for f in folders])
    return found.filter(inside & text.suffix(F.col("path")).isin(*MEDIA) & ~text.basename(F.col("path")).startswith("."))


def _plain(value):
    """Dates become ISO strings."""
    return value.isoformat() if hasattr(value, "isoformat") else value


def parse_yaml(block: str | None) -> dict | None:
    """A mapping, or null for anything else."""
    import yaml

    try:
        found = yaml.safe_load(block) if block is not None else None
    except yaml.YAMLError:
        return None
    return {k: _plain(v) for k, v in found.items()} if isinstance(found, dict) else None


def frontmatter_block(body: Column) -> Column:
    """The block between a leading ``---`` and the next line that begins with it; null without one."""
    return F.when(body.rlike(r"(?s)^---.*?\n---"), F.regexp_extract(body, r"(?s)^---(.*?)\n---", 1))


def strip_frontmatter(body: Column) -> Column:
    """A text without its leading block; here both rules must be lines of their own."""
    return F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", "")


def frontmatter(body: Column) -> Column:
    """The parsed block of each text as a struct; null if there is none or it is no mapping."""

    @F.pandas_udf(FRONTMATTER)
    def parse(blocks: pd.Series) -> pd.DataFrame:
        rows = []
        for block in blocks:
            found = parse_yaml(block)
            if found is None:
                rows.append([None] * 5)
                continue
            known = found.pop("related", None), found.pop("last_reviewed", None), found.pop("status", None), found.pop("id", None)
            related = [str(x) for x in known[0]] if isinstance(known[0], list) else []
            rest = {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in found.items()}
            rows.append([related, *(None if k is None else str(k) for k in known[1:]), rest])
        return pd.DataFrame(rows, columns=["related", "last_reviewed", "status", "id", "other"], dtype=object)

    found = parse(frontmatter_block(body))
    return F.when(found["other"].isNotNull(), found)


def sections(docs: DataFrame) -> DataFrame:
    """path, page, heading and text of the sections of markdown (path, text), cut before second and third level headings.

    Sections that are blank or nothing but a heading are left out; page counts all pieces, with an empty one in front of
    a text that begins with a heading.
    """
    body = strip_frontmatter(F.col("text"))
    pieces = F.split(body, r"(?m)(?=^#{2,3}\s)")
    offset = F.when(body.rlike(r"^#{2,3}\s"), 2).otherwise(1)
    cut = docs.select("path", offset.alias("_o"), F.posexplode(pieces).alias("_i", "_raw"))
    clean = F.regexp_replace("_raw", r"(?U)^\s+|\s+$", "")
    cut = cut.select("path", (F.col("_i") + F.col("_o")).alias("page"), clean.alias("text")).filter(F.length("text") > 0)
    first = F.substring_index("text", "\n", 1)
    headed = F.col("text").startswith("#")
    cut = cut.filter(~(headed & (F.instr("text", "\n") == 0)))
    return cut.select("path", "page", F.when(headed, F.rtrim(first)).otherwise("(intro)").alias("heading"), "text")


def sidecars(spark: SparkSession, root: str, folder: str = ".loom/sidecars") -> DataFrame:
    """The metadata files under a folder: sidecar_path, the parsed fields, and whether parsing failed."""
    found = files(spark, root, "*.embed-meta.yaml", inside=folder)
    schema = T._parse_datatype_string(SIDECAR)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, body in zip(pdf["path"], pdf["text"]):
                got = parse_yaml(body)
                row = {f.name: (got or {}).get(f.name) for f in schema}
                for f in schema:
                    if isinstance(f.dataType, T.StringType) and row[f.name] is not None:
                        row[f.name] = str(row[f.name])
                rows.append({"sidecar_path": path, "failed": got is None} | row)
            yield pd.DataFrame(rows, columns=["sidecar_path", "failed", *schema.names], dtype=object)

    return found.select("path", F.decode("content", "utf-8").alias("text")).mapInPandas(parse, f"sidecar_path string, failed boolean, {SIDECAR}")


def registry(sidecar: DataFrame, source: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """One row for each sidecar_id (the last by path), with file_path only if the source file is there."""
    from pyspark.sql import Window

    ok = sidecar.filter(~F.col("failed") & (F.coalesce("sidecar_id", F.lit("")) != "")).filter(~text.excluded_inside(F.col("sidecar_path"), list(excluded)))
    last = F.row_number().over(Window.partitionBy("sidecar_id").orderBy(F.desc("sidecar_path")))
    ok = ok.withColumn("_r", last).filter("_r = 1").drop("_r")
    there = source.select(F.col("path").alias("file_path")).distinct()
    return ok.join(there, F.col("current_path") == F.col("file_path"), "left")


def parts_of(rows: int, *tables: DataFrame) -> int:
    """How many parts of about so many rows the largest of the tables makes."""
    return max(1, *(-(-t.count() // rows) for t in tables))


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df by a key in so many parts. What one task sorts or hashes then goes by rows, however well they compress; one part is left to AQE."""
    return df.repartition(parts, key) if parts > 1 else df


def chunk_index(points: DataFrame) -> DataFrame:
    """Stored points by sidecar_id: ids in order, count, first text and kind, file path. Points without one are skipped."""
    first = lambda c: F.min_by(c, F.struct("chunk_index", "point_id"))
    points = points.filter(F.coalesce("sidecar_id", F.lit("")) != "")
    return dealt(points, "sidecar_id", parts_of(POINT_ROWS, points)).groupBy("sidecar_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "point_id"))), lambda s: s["point_id"]).alias("chunk_ids"),
        F.count(F.lit(1)).alias("chunk_count"), first("text").alias("first_text"), first("doc_type").alias("doc_type"), first("file_path").alias("file_path"),
    )


def edges(docs: DataFrame) -> DataFrame:
    """The directed related graph of documents (path, frontmatter): src, dst and place in the list."""
    return docs.select(F.col("path").alias("src"), F.posexplode("frontmatter.related").alias("pos", "dst")).select("src", "dst", "pos")


def collections(spark: SparkSession) -> DataFrame:
    """Names of the catalogue's tables that are collections."""
    names = [(t.name,) for t in spark.catalog.listTables()]
    return spark.createDataFrame(names, "name string").filter(F.col("name").rlike(COLLECTION))


def last_commits(log: DataFrame) -> DataFrame:
    """From a commit log (path, commit, committed): the last date that touched each path."""
    return log.groupBy("path").agg(F.max("committed").cast("date").alias("last_commit"))


def changed_since(log: DataFrame, after: str, excluded: Iterable[str] = ()) -> DataFrame:
    """Markdown and metadata paths touched by commits after one (all of them if it is unknown)."""
    since = log.filter(F.col("commit") == after).agg(F.max("committed")).scalar()
    kind = F.col("path").endswith(".md") | F.col("path").endswith(".embed-meta.yaml")
    found = log.filter(kind & ~text.excluded(F.col("path"), list(excluded))).withColumn("_since", since)
    return found.filter(F.col("_since").isNull() | (F.col("committed") > F.col("_since"))).select("path").distinct()


def heads(log: DataFrame) -> DataFrame:
    """The first and the last commit of a log."""
    return log.agg(F.max_by("commit", "committed").alias("head"), F.min_by("commit", "committed").alias("first"))


def previous_scan(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored scan, or nothing if it can't be read."""
    from pyspark.errors import PySparkException

    try:
        found = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)
        return found if found.take(1) else None
    except PySparkException:
        return None


def pending(sidecar: DataFrame, source: DataFrame, status: str = "pending") -> DataFrame:
    """Metadata rows of a status whose source file is there."""
    return sidecar.filter(F.col("status") == status).join(source.select(F.col("path").alias("current_path")).distinct(), "current_path", "left_semi")


def lfs_pointers(found: DataFrame) -> DataFrame:
    return found.filter(ids.is_lfs_pointer(F.col("content"))).select("path")


def base64_images(found: DataFrame) -> DataFrame:
    return found.select("path", F.coalesce(F.base64("content"), F.lit("")).alias("image"))


class PageReader(Protocol):
    """Turns the bytes of a paged file into pages: lines with the largest font size of each."""

    def __call__(self, content: bytes) -> list[list[tuple[str, float]]]: ...


def pages(found: DataFrame, reader: PageReader, heading_points: float = 13.0) -> DataFrame:
    """path, page, text and headings of paged files (path, content). Blank lines are dropped; large lines are headings."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for n, lines in enumerate(reader(bytes(content)), 1):
                    kept = [(s.strip(), size) for s, size in lines if s.strip()]
                    rows.append((path, n, "\n".join(s for s, _ in kept), [s for s, size in kept if size >= heading_points]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "headings"])

    return found.select("path", "content").mapInPandas(read, "path string, page int, text string, headings array<string>")


def merged_config(base: Mapping, override: Mapping) -> dict:
    """Settings with those of a user on top; mappings are merged at every level, other values replaced."""
    out = copy.deepcopy(dict(base))
    for key, value in override.items():
        both = isinstance(out.get(key), Mapping) and isinstance(value, Mapping)
        out[key] = merged_config(out[key], value) if both else copy.deepcopy(value)
    return out


def checked_config(config: Mapping) -> dict:
    """Settings that name a project and a store; else an error."""
    for key in ("project_name", "qdrant_url"):
        if not isinstance(config.get(key), str) or not config[key].strip():
            raise ValueError(f"{key} must be a string that is not empty")
    return dict(config)


def find_upwards(start: PurePosixPath, exists, name: str = ".loom/config.yaml") -> PurePosixPath | None:
    """The nearest settings file at or above a folder. exists: tells whether a path is there."""
    for folder in (start, *start.parents):
        if exists(folder / name):
            return folder / name
    return None
