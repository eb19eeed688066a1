"""What the training-data operators share: reading tables, checkpoints, text buffers and hashes in numpy.

Hashes are 64-bit polynomials over bytes whose prefix sums are kept, so the hash of any byte range costs two look-ups;
within one text a collision has odds far below 1e-9; what is decided between texts goes by 128 bits or is checked.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; one longer text is handled whole.
SLICE_BYTES = 1 << 20

#: ASCII white space: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDS = np.random.default_rng(20240229)
_BYTE = _SEEDS.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns (those that it has), and all others in one struct, `_carried`, where their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*(c for c in df.columns if c in names), *([F.struct(*others).alias("_carried")] if others else []))


def restored(columns: list[str], *names: str) -> list[Column]:
    """The columns that `carried` was given, in their order."""
    return [F.col(f"`{c}`") if c in names else F.col("_carried").getField(c).alias(c) for c in columns]


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a local session, such as tests have, gets one of its own where neither is set; a cluster has to name one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "")
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not base and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="loom-checkpoint-"))
        held = context._jsc.sc().getCheckpointDir()
    return base or held.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the folder that all executors share; a lost executor loses nothing of it."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, for a table that several steps read."""
    return f"{shared(spark).rstrip('/')}/loom-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that nothing refers to any more.

    It works when the driver collects garbage, which small driver heaps with little to do may not for a long time; a
    chain of steps over large tables would hold the files of all of them.
    """
    for _ in range(3):  # plans refer to exchanges through objects that are themselves only dropped by a collection
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, (n - 1).bit_length()))
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more than there are texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text each; every row is in one of them."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.diff(buffers(column)[1])
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """The words (runs of bytes other than ASCII white space) of several texts, and hashes of them.

    start, end: byte ranges; doc: the text each is in; first: the number of the first word of each text (one more than
    there are texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        np.logical_not(SPACE[data], out=inside[:n])
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside[:n]
        cut = offsets[:-1]
        before[cut[cut < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        stop = np.zeros(n + 1, dtype=bool)
        stop[: n + 1] = ~inside
        stop[cut] = True
        stop[n] = True
        ends = np.flatnonzero(stop[1:] & inside[:n]) + 1
        self.end = ends
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._rolled: tuple[np.ndarray, np.ndarray] | None = None

    def hashes(self) -> np.ndarray:
        return ranges(self.data, self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of the first word of each run of k words within a text, and the rolling hash of the run.

        The hash is a polynomial of the words' hashes; running sums of its terms roll it on by one word in one step.
        """
        if len(hashes) < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :])
        if self._rolled is None or self._rolled[0] is not hashes:
            total = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(hashes * powers(_BASE, len(hashes)), out=total[1:])
            self._rolled = hashes, total
        total = self._rolled[1]
        return at, mix((total[at + k] - total[at]) * powers(_UNBASE, len(hashes) + 1)[at])


def ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    out = (sums[end] - sums[start]) * powers(_UNBASE, len(data) + 1)[start]
    return mix(out ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at another place too."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    ordered = keys[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(keys), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(n: int, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places are in one of the ranges that begin at at."""
    steps = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(at + length, n), minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the runs that begin at first."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
