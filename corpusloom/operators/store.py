"""Collections of points: creation, points from chunks and pages, upserts in batches, page files, one writer at a time.

A collection is a Parquet table whose vector column carries its size and distance as metadata.
"""

from __future__ import annotations

import os
import socket
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids

#: Sizes of text and page vectors, and points sent at once.
TEXT_SIZE, PAGE_SIZE = 768, 128
TEXT_BATCH, PAGE_BATCH = 32, 4

_FLOATS = T.ArrayType(T.FloatType())
KINDS = {
    "text": T.StructField("vector", _FLOATS, True, {"size": TEXT_SIZE, "distance": "cosine"}),
    "visual": T.StructField("vectors", T.ArrayType(_FLOATS), True, {"size": PAGE_SIZE, "distance": "cosine", "comparator": "max_sim"}),
}

Send = Callable[[list[dict]], None]


def create_if_missing(spark: SparkSession, folder: str, name: str, kind: str = "text", payload: str = "text string") -> DataFrame:
    """The collection of a name; an empty one is made if there is none."""
    schema = T.StructType([T.StructField("id", T.StringType()), KINDS[kind], *T.StructType.fromDDL(payload).fields])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def points(chunks: DataFrame) -> DataFrame:
    """Points of embedded chunks (slug, chunk_index, text, vector and further payload) with their life-cycle fields. Without a vector there is none."""
    have = set(chunks.columns)
    given = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default)
    plain = ids.point_id(F.col("slug"), F.col("chunk_index"))
    id_ = plain
    if "doc_generation" in have:
        id_ = F.when(F.col("doc_generation").isNull(), plain).otherwise(ids.point_id_versioned(F.col("slug"), F.col("chunk_index"), F.col("doc_generation")))
    out = chunks.filter(F.col("vector").isNotNull() & F.col("slug").isNotNull() & F.col("chunk_index").isNotNull()).withColumn("id", id_)
    fresh = {c: F.lit(None).cast("string") for c in ("stale_as_of", "superseded_at", "orphaned_at")}
    kept = {"doc_generation": given("doc_generation", "int", 1), "sidecar_id": given("sidecar_id", "string", ""), "chunk_source_hash": given("chunk_source_hash", "string", "")}
    return out.withColumns(kept | fresh)


def visual_points(pages: DataFrame) -> DataFrame:
    """Points of embedded pages (slug, page_num, vectors and further payload); the image itself is no payload."""
    kind = F.coalesce(F.col("doc_type"), F.lit("visual_page")) if "doc_type" in pages.columns else F.lit("visual_page")
    rows = pages.filter(F.col("vectors").isNotNull() & F.col("slug").isNotNull() & F.col("page_num").isNotNull())
    return rows.withColumn("id", ids.visual_point_id(F.col("slug"), F.col("page_num"))).withColumn("doc_type", kind).drop("png_bytes")


def batches(rows: DataFrame, order: str, size: int = TEXT_BATCH, key: str = "slug") -> DataFrame:
    """rows with `batch`, the number of their batch among those of the same document."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("batch", F.floor((number - 1) / size).cast("int"))


def send(rows: DataFrame, order: str, connect: Callable[[], Send], size: int = TEXT_BATCH, key: str = "slug") -> DataFrame:
    """key, batch and `sent`, the number of points that a store took: all of a batch, or none if it failed.

    connect is called once a task. Ids are deterministic, so that a batch that is sent again changes nothing.
    """
    whole = batches(rows, order, size, key).groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rows.columns if c != order)))).alias("points"))
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put = None
        for pdf in frames:
            put, sent = put or connect(), []
            for found in pdf["points"]:
                given = [p if isinstance(p, dict) else p.asDict() for p in found]
                try:
                    put(given)
                    sent.append(len(given))
                except Exception:  # noqa: BLE001  whatever a store's client raises
                    sent.append(0)
            yield pdf[[key, "batch"]].assign(sent=sent)

    return whole.mapInPandas(run, f"{key} {kind}, batch int, sent int")


def write_page_files(pages: DataFrame, folder: str) -> DataFrame:
    """Write each page's image (path, png) below a folder that all executors share; the paths. A file is put in place whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, png in zip(pdf["path"], pdf["png"]):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{socket.gethostname()}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(png)
                os.replace(part, target)
            yield pdf[["path"]]

    return pages.filter(F.col("path").isNotNull() & F.col("png").isNotNull()).select("path", "png").mapInPandas(run, "path string")


class Busy(Exception):
    """Another writer is at work."""


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


@contextmanager
def single_writer(path: str) -> Iterator[None]:
    """Hold a lock file while writing. A file of a dead process of this host, or one that names none, is taken over; else Busy."""
    me = f"{socket.gethostname()} {os.getpid()}"
    for _ in range(10):
        try:
            with open(path, "x") as f:
                f.write(me)
            break
        except FileExistsError:
            pass
        try:
            host, _, pid = open(path).read().strip().rpartition(" ")
        except FileNotFoundError:
            continue
        if pid.isdigit() and int(pid) > 0 and (host != socket.gethostname() or _alive(int(pid))):
            raise Busy(f"{path} is held by process {pid} of {host}")
        try:
            os.unlink(path)
        except FileNotFoundError:
            pass
    else:
        raise Busy(f"{path} could not be taken")
    try:
        yield
    finally:
        os.unlink(path)
