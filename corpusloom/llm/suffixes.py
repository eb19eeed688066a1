"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts somewhere else are removed.

Suffixes of all places would be 200 times the input. Two equal strings of SPAN bytes have the same minimiser (the
leftmost of the least hashes among their LEAD-byte strings), so it is enough to sort suffixes at minimisers, about one
place in 77, and to look to both sides of them. Every string of SPAN bytes is looked at through its minimiser:

1. Anchors: the minimisers of each text. Counts of their leading bytes, aggregated before the shuffle; anchors whose
   leading bytes occur once can't be in a repeat and go no further.
2. Contexts: SPAN bytes from each anchor on, and SPAN - LEAD bytes before it. Equal contexts become one row with a count.
3. Spark samples splitters and deals the contexts into ranges of their leading bytes. Equal leading bytes are never
   dealt apart, so what lies on two sides of a boundary differs within LEAD < SPAN bytes: comparing across a boundary
   always yields a common prefix too short to count, and no string is missed there.
4. Each range is sorted locally by multikey quicksort (eight bytes at a step, only ties go on), forwards and backwards,
   which gives longest common prefixes of neighbours on both sides. A string that begins j bytes before its anchor is
   repeated if another row is in its class both by j bytes backwards and by SPAN - j forwards.
5. Leading bytes with more than BLOCK occurrences do not fit one task: there the strings themselves are hashed
   (128 bits), counted with aggregation before the shuffle, and joined back. Same result, any size.
6. Byte ranges of each document are merged and cut out.

Defined cases: null text is empty; texts under SPAN bytes keep all; an equal row elsewhere counts as elsewhere; null and
repeated ids are ordinary (documents are told apart by hashes of id and text); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, buffers, checkpoint, mix, release, remove, shared_folder, slices, table

SPAN, LEAD = 200, 48
BACK = SPAN - LEAD
#: Largest group of equal leading bytes that is sorted in one task, and rows sorted at once.
BLOCK, ROWS = 65_536, 16_384

_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)]
_HIGH = np.uint64(0xFFFFFFFF00000000)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimisers of all SPAN-byte strings inside the texts, and hashes of the LEAD bytes from there."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = _BYTE[data]
    for i, d in enumerate((1, 2, 4, 8)):
        h = h[:-d] * _STEP[i] + h[d:]
    h16 = h
    h = h[:-16] * _STEP[4] + h[16:]
    h = mix(h[:-16] * _STEP[5] + h16[32:])
    least = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    for d in (1, 2, 4, 8, 16, 32, 64):
        least = np.minimum(least[:-d], least[d:])
    rest = BACK + 1 - 128
    least = np.minimum(least[:-rest], least[rest:])
    steps = np.zeros(len(least) + 1, dtype=np.int32)
    starts, stops = offsets[:-1], offsets[1:] - SPAN + 1
    some = stops > starts
    np.add.at(steps, starts[some], 1)
    np.add.at(steps, stops[some], -1)
    inside = np.cumsum(steps[:-1]) > 0
    at = least[inside] & ~_HIGH
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.unique(at[np.concatenate([[True], at[1:] != at[:-1]])]).astype(np.int64)
    return at, h[at]


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow binary column."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = buffers(part.column("text"))
            at, lead = anchors(data, offsets)
            doc = np.searchsorted(offsets, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([part.column("h1").take(pa.array(doc)), pa.array((at - offsets[doc]).astype(np.int64)), pa.array(lead.view(np.int64))], ["h1", "at", "lead"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            lead, n = np.unique(anchors(*buffers(part.column("text")))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(n)], ["lead", "n"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 18):
            data, offsets = buffers(part.column("text"))
            places = part.column("places")
            counts = places.value_lengths().to_numpy()
            flat = places.flatten()
            doc = np.repeat(np.arange(len(counts)), counts)
            at = flat.field("at").to_numpy() + offsets[doc]
            ok = at < offsets[doc + 1]  # places of another text whose first hash is the same may lie outside
            doc, at, wide = doc[ok], at[ok], flat.field("wide").filter(pa.array(ok))
            before, after = np.maximum(at - BACK, offsets[doc]), np.minimum(at + SPAN, offsets[doc + 1])
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [part.column("h1").take(rows), part.column("h2").take(rows), pa.array(at - offsets[doc]), wide, _pieces(data, before, at), _pieces(data, at, after)],
                ["h1", "h2", "at", "wide", "left", "right"],
            )


def words_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Byte ranges as rows of big-endian 64-bit words, padded with zeros; back: each read from its end."""
    column, out = np.arange(width), np.zeros((len(start), width), dtype=np.uint8)
    for i in range(0, len(start) if len(data) else 0, 4096):  # so many rows at once, as places take eight times their bytes
        part = slice(i, i + 4096)
        place = (start[part] + size[part])[:, None] - 1 - column if back else start[part, None] + column
        inside = column < size[part, None]
        out[part][inside] = data[place[inside]]
    return out.view(">u8").astype(np.uint64)


def multikey_sort(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of the rows, and the common bytes of each with the one before it in that order.

    One word at a step: rows are split by it, and only runs that tie go on to the next word; shorter rows come first
    among equal ones.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    # first word at which a row in order differs from the one before it; the width if in none
    ordered = words[order, 0]
    differs = np.full(n, words.shape[1])
    differs[np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))] = 0
    for k in range(1, words.shape[1]):
        tied = differs == words.shape[1]
        run = tied | np.append(tied[1:], False)
        at = np.flatnonzero(run)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        value = words[order[at], k]
        inner = np.lexsort((value, group))
        order[at] = order[at][inner]
        value, group = value[inner], group[inner]
        new = np.concatenate([[False], (group[1:] == group[:-1]) & (value[1:] != value[:-1])])
        differs[at[new]] = k
    tied = differs == words.shape[1]
    if tied.any():
        at = np.flatnonzero(tied | np.append(tied[1:], False))
        group = np.cumsum(~tied[at])
        order[at] = order[at][np.lexsort((size[order[at]], group))]
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        k = differs[1:]
        cap = np.minimum(k, words.shape[1] - 1)
        x = words[order[1:], cap] ^ words[order[:-1], cap]
        zeros = np.zeros(n - 1, dtype=np.int64)
        left = np.ones(n - 1, dtype=bool)
        for b in range(8):
            left &= ((x >> np.uint64(56 - 8 * b)) & np.uint64(255)) == 0
            zeros += left
        common[1:] = np.minimum(cap * 8 + zeros, np.minimum(size[order[1:]], size[order[:-1]]))
    return order, common


def repeats(left: tuple, right: tuple, times: np.ndarray) -> np.ndarray:
    """For each row and each j of 0 .. BACK, whether the SPAN bytes from j before its anchor occur again.

    left, right: (bytes, starts, sizes) of the contexts; times: occurrences of each row's context.
    """
    n = len(times)
    lsize, rsize = left[2], right[2]
    back, lcommon = multikey_sort(words_of(*left, BACK, True), lsize)
    ahead, rcommon = multikey_sort(words_of(*right, SPAN, False), rsize)
    out = np.zeros((n, BACK + 1), dtype=bool)
    # the most that a row shares with any other on each side
    reach = np.zeros(n, dtype=np.int64)
    for order, common in ((back, lcommon), (ahead, rcommon)):
        near = np.maximum(common, np.append(common[1:], 0))
        reach[order] += near
    some = reach >= SPAN
    for j in range(BACK + 1):
        fits = (lsize >= j) & (rsize >= SPAN - j)
        out[:, j] = fits & (times > 1)
        rows = np.flatnonzero(fits & some)
        if len(rows) < 2:
            continue
        lclass, rclass = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        lclass[back] = np.cumsum(lcommon < j) if j else 0
        rclass[ahead] = np.cumsum(rcommon < SPAN - j)
        key = rclass[rows] * (n + 1) + lclass[rows]
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
        out[rows[order[same[1:] | same[:-1]]], j] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    edge = np.zeros((len(flags), flags.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)
    return row, lo, hi - 1


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a range, ordered by leading bytes; handled in runs that never part equal leading bytes."""

    def handle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        sides = []
        for name in ("left", "right"):
            data, offsets = _binary(rows.column(name))
            sides.append((data, offsets[:-1], np.diff(offsets)))
        row, lo, hi = _runs(repeats(*sides, rows.column("times").to_numpy()))
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([_one(rows, "c1").take(take), _one(rows, "c2").take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["c1", "c2", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            lead = _one(rows, "start").to_pylist()
            cut = len(lead) - 1
            while cut > 0 and lead[cut - 1] == lead[-1]:
                cut -= 1
            if cut:
                yield handle(rows.slice(0, cut))
                rows = rows.slice(cut)
            held, n = rows.to_batches(), rows.num_rows
    if n:
        yield handle(pa.Table.from_batches(held))


def _one(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = pa.chunked_array([c.cast(pa.large_binary()) for c in column.chunks], pa.large_binary()).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of each document, which follow each other by their begin, as ranges that neither meet nor overlap."""
    key, runs, out = None, [], []

    def rows() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), kinds)], ["h1", "h2", "found"])

    for batch in batches:
        h1, h2, lo, hi = (c.to_numpy() for c in batch.columns)
        # runs within the batch first: a row begins one if it is of another document or beyond all that came before it
        doc = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, dtype=bool)
        number = np.cumsum(doc)
        reach = np.maximum.accumulate(hi + number * (1 << 40)) - number * (1 << 40) if len(hi) else hi
        new = doc.copy()
        new[1:] |= lo[1:] > reach[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(lo)) - 1
        for a, b, x, y in zip(h1[at].tolist(), h2[at].tolist(), lo[at].tolist(), reach[last].tolist()):
            if (a, b) != key:
                if key is not None:
                    out.append((*key, runs))
                    if len(out) >= 4096:
                        yield rows()
                        out = []
                key, runs = (a, b), []
            if runs and x <= runs[-1]["hi"]:
                runs[-1]["hi"] = max(runs[-1]["hi"], y)
            else:
                runs.append({"lo": x, "hi": y})
    if key is not None:
        out.append((*key, runs))
    yield rows()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 22):
            data, offsets = buffers(part.column("text"))
            out = []
            for i, found in enumerate(part.column("found").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                kept, at, removed, spans, last = hashlib.sha256(), 0, 0, 0, -1
                for r in sorted((r["lo"], r["hi"]) for r in found or ()):
                    lo, hi = r
                    if lo > last:
                        kept.update(text[at:lo])
                        spans += 1
                        removed += hi - lo
                        at = last = hi
                    elif hi > last:
                        removed += hi - last
                        at = last = hi
                kept.update(text[at:])
                out.append((len(text), removed, spans, kept.hexdigest()))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def ranges(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each document (h1, h2) the byte ranges [lo, hi) to remove; they may overlap. docs: h1, h2, text."""
    spark = docs.sparkSession
    # checkpointed, so that the join below is between plain exchanges, of which AQE splits a common lead's rows
    counts = checkpoint(docs.select("text").mapInArrow(_leads, "lead long, n long").groupBy("lead").agg(F.sum("n").alias("n")).filter("n > 1"))
    at = docs.select("h1", "text").mapInArrow(_found, "h1 long, at long, lead long").join(counts, "lead")
    places = at.groupBy("h1").agg(F.collect_set(F.struct("at", (F.col("n") > block).alias("wide"))).alias("places"))
    rows = docs.join(places, "h1").select("h1", "h2", "text", "places").mapInArrow(_contexts, "h1 long, h2 long, at long, wide boolean, left binary, right binary")
    path = shared_folder(spark)
    rows.select("*", F.xxhash64("left", "right").alias("c1"), F.xxhash64("right", F.lit(1), "left").alias("c2")).write.option("compression", "zstd").parquet(path)
    del counts, at, places, rows
    release(spark)
    rows = spark.read.parquet(path)

    # wide belongs to the leading bytes, so equal contexts agree on it; as a key it is filtered on before the shuffle
    merged = rows.groupBy("c1", "c2", "wide").agg(F.count(F.lit(1)).alias("times"), F.first("left").alias("left"), F.first("right").alias("right"))
    narrow = merged.filter("NOT wide").withColumn("start", F.substring("right", 1, LEAD))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartitionByRange(tasks, "start").sortWithinPartitions("start").select("c1", "c2", "times", "left", "right", "start")
    found = dealt.mapInArrow(_sorted, "c1 long, c2 long, lo int, hi int")

    whole, long = F.concat("left", "right"), F.octet_length("left")
    each = merged.filter("wide").select("c1", "c2", "times", whole.alias("whole"), long.alias("long"), F.octet_length("right").alias("ahead"))
    first, last = F.greatest(F.lit(0), SPAN - F.col("ahead")), F.least(F.lit(BACK), F.col("long"))
    each = each.filter(first <= last).withColumn("j", F.explode(F.sequence(first, last)))
    # with j, as one place may be looked at from several anchors, at another j each
    piece = F.substring(F.col("whole"), F.col("long") - F.col("j") + 1, F.lit(SPAN))
    each = each.select("c1", "c2", "times", "j", piece.alias("piece")).select("c1", "c2", "times", "j", F.xxhash64("j", "piece").alias("p1"), F.xxhash64(F.lit(1), "piece", "j").alias("p2"))
    again = each.groupBy("p1", "p2").agg(F.sum("times").alias("n")).filter("n > 1").drop("n")
    wide = each.join(again, ["p1", "p2"]).groupBy("c1", "c2").agg(F.array_sort(F.collect_set("j")).alias("js"))
    # at most BACK + 1 places of a context, as runs
    run = F.struct(F.lit(0).alias("lo"), F.lit(-2).alias("hi"))
    step = lambda acc, j: F.when(
        acc["now"]["hi"] == j - 1, F.struct(F.struct(acc["now"]["lo"].alias("lo"), j.alias("hi")).alias("now"), acc["runs"].alias("runs"))
    ).otherwise(F.struct(F.struct(j.alias("lo"), j.alias("hi")).alias("now"), F.concat(acc["runs"], F.array(acc["now"])).alias("runs")))
    start = F.struct(run.alias("now"), F.array().cast("array<struct<lo:int,hi:int>>").alias("runs"))
    runs = F.aggregate("js", start, step, lambda acc: F.concat(acc["runs"], F.array(acc["now"])))
    wide = wide.select("c1", "c2", F.inline(F.filter(runs, lambda r: r["hi"] >= 0)))

    found = checkpoint(found.unionByName(wide))
    del merged, narrow, dealt, each, again, wide
    release(spark)
    where = rows.select("h1", "h2", "at", "c1", "c2").join(found, ["c1", "c2"])
    where = where.select("h1", "h2", (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo") + SPAN).alias("hi"))
    out = where.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "lo").mapInArrow(_merged, "h1 long, h2 long, found array<struct<lo:long,hi:long>>")
    out = checkpoint(out)
    del rows, found, where
    remove(spark, path)
    release(spark)
    return out


def dedup(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row of (doc_id, text): n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", F.lit(1), "doc_id").alias("h2"))
    found = ranges(docs, block)
    both = docs.join(found, ["h1", "h2"], "left").select("doc_id", "text", "found")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


#: Every string of SPAN bytes by its MD5 sum: for small tables only.
SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), places AS (
  SELECT r, unnest(range(octet_length(b) - {SPAN - 1})) AS i FROM texts WHERE octet_length(b) >= {SPAN}
), strings AS (
  SELECT r, i, md5_number(b[i + 1:i + {SPAN}]) AS h FROM places JOIN texts USING (r)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM strings) WHERE n > 1
), begins AS (
  SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {SPAN}, true) AS new FROM again
), spans AS (
  SELECT r, min(i) AS lo, max(i) + {SPAN} AS hi FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS s FROM begins) GROUP BY r, s
), pieces AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS e FROM spans
  UNION ALL SELECT t.r, coalesce(max(hi), 0), octet_length(any_value(t.b)) FROM texts t LEFT JOIN spans USING (r) GROUP BY t.r
), kept AS (
  SELECT r, string_agg(hex(b[a + 1:e]), '' ORDER BY a) AS k FROM pieces JOIN texts USING (r) GROUP BY r
), removed AS (
  SELECT r, sum(hi - lo) AS n, count(*) AS spans FROM spans GROUP BY r
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM texts JOIN kept USING (r) LEFT JOIN removed USING (r)
"""
