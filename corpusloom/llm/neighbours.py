"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample (FIT_ROWS vectors, those with the least hashes of their ids): the exact neighbour graph of
the sample, a balanced partition of that graph (recursive bisection along a smooth vector of the graph, then exchanges
that cut fewer edges and keep the sizes) into one part for each BLOCK_ROWS rows of the table, within PARTS and MOST_PARTS,
and a small classifier (one hidden layer) that predicts the part of a vector. Indexing covers every row: it goes to its
most probable part. A query goes to its most probable parts; how many is measured on the whole index, as the fewest that
reach GOAL recall for TESTED vectors that the classifier was not fitted on, whose nearest rows are found by brute force.
Neighbours are nearer in a larger table, so a query then visits a smaller share of it. Parts are searched exactly, in
blocks, and the best of all parts are merged; scores are inner products of the original vectors in double precision.

Large parts are dealt over several blocks by hash, so that a part that holds many rows is several tasks. Equal vectors are
one vector with a list of ids: the least TOP + 1 of them, which is all that a list of the TOP nearest can show.

Defined cases: vectors that are null, zero, of another length than the first part of the table's, or that hold null or
non-finite components take no part; a query's own row is no candidate, rows equal to it with another id are; rows that
repeat an id with an equal vector count once; ties go to smaller ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

TOP, EVERY = 20, 20
#: Fitting: rows of the sample, neighbours in its graph, least and most parts, hidden units, passes.
FIT_ROWS, GRAPH, PARTS, MOST_PARTS, HIDDEN, PASSES = 8_192, 10, 16, 128, 64, 60
#: Recall aimed at, and vectors that it is measured with.
GOAL, TESTED = 0.95, 256
#: Rows of a block that is searched by one call, and queries that meet a block at once.
BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096


@dataclass
class Router:
    """The fitted classifier."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each vector, most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product for each query."""
    k = min(k, len(rows))
    out = []
    for i in range(0, len(queries), 1024):
        s = queries[i : i + 1024] @ rows.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1), axis=1))
    return np.concatenate(out)


def balanced_parts(links: np.ndarray, x: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Parts of equal size (to one) of a graph given as neighbour lists; few links are cut."""
    n = len(links)
    src, dst = np.repeat(np.arange(n), links.shape[1]), links.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(5)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        inside = np.full(n, -1)
        inside[rows] = np.arange(len(rows))
        keep = (inside[src] >= 0) & (inside[dst] >= 0)
        a, b = inside[src[keep]], inside[dst[keep]]
        degree = np.maximum(np.bincount(a, minlength=len(rows)), 1)
        v = x[rows] @ np.linalg.svd(x[rows] - x[rows].mean(axis=0), full_matrices=False)[2][0] + 1e-6 * rng.normal(size=len(rows))
        for _ in range(40):  # towards the smoothest vector that is not constant
            v = v - v.mean()
            v = 0.5 * v / max(np.abs(v).max(), 1e-300) + 0.5 * np.bincount(a, v[b], len(rows)) / degree / max(np.abs(v).max(), 1e-300)
        left = len(rows) * (count // 2) // count
        side = np.ones(len(rows), dtype=bool)
        side[np.argsort(v, kind="stable")[:left]] = False
        for _ in range(rounds):  # exchange the rows that gain most
            gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), len(rows))
            up, down = np.flatnonzero(~side), np.flatnonzero(side)
            up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
            m = min(len(up), len(down))
            swap = int((gain[up[:m]] + gain[down[:m]] > 0).sum()) // 2
            if not swap:
                break
            side[up[:swap]], side[down[:swap]] = True, False
        halve(rows[~side], first, count // 2)
        halve(rows[side], first + count // 2, count - count // 2)

    halve(np.arange(n), 0, parts)
    return part


def fit(x: np.ndarray, parts: int = PARTS, seed: int = 3) -> Router:
    """Fit a router on sample vectors."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    parts = max(1, min(parts, n // 64))
    u = unit(x)
    near = nearest(u, u, min(GRAPH + 1, n))
    label = balanced_parts(near[:, 1:] if near.shape[1] > 1 else near, u, parts)
    w1, w2 = rng.normal(size=(d, HIDDEN)) * (2 / d) ** 0.5 * d**0.5 / 2, rng.normal(size=(HIDDEN, parts)) * HIDDEN**-0.5
    params = [w1, np.zeros(HIDDEN), w2, np.zeros(parts)]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    train = np.arange(n) if parts > 1 else np.zeros(0, dtype=np.int64)
    step = 0
    for _ in range(PASSES):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            if not len(rows):
                continue
            h = np.maximum(u[rows] @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            back = (p @ params[2].T) * (h > 0)
            step += 1
            for q, g, m in zip(params, (u[rows].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0)), moment):
                g = g + 1e-4 * q
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                q -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Router(*params)


def visits(index: DataFrame, router: Router, tested: np.ndarray, top: int = TOP, goal: float = GOAL) -> int:
    """The fewest parts that hold the goal's share of the nearest rows of the index (part, embedding) to the tested vectors.

    A brute-force pass over the index for a fixed number of vectors: each task sends `top` rows for each of them.
    """
    parts = len(router.b2)
    if parts == 1 or not len(tested):
        return parts

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[np.ndarray]] = [[np.zeros(0), np.zeros(0, dtype=np.int64)] for _ in tested]
        for pdf in frames:
            if not len(pdf):
                continue
            x, part = np.stack(pdf["embedding"].to_numpy()), pdf["part"].to_numpy()
            for i, s in enumerate(tested @ x.T):
                k = min(top + 1, len(s))
                at = np.argpartition(-s, k - 1)[:k]
                at = at[(x[at] != tested[i]).any(axis=1)]  # the vector itself is no neighbour
                score, where = np.concatenate([best[i][0], s[at]]), np.concatenate([best[i][1], part[at]])
                keep = np.argsort(-score, kind="stable")[:top]
                best[i] = [score[keep], where[keep]]
        yield pd.DataFrame({"q": np.repeat(np.arange(len(best)), [len(b[0]) for b in best]), "score": np.concatenate([b[0] for b in best]), "part": np.concatenate([b[1] for b in best])})

    found = index.select("embedding", "part").mapInPandas(near, "q int, score double, part int")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "part")
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).groupBy("q", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most tested x top rows
    rank = np.argsort(router.parts(tested, parts), axis=1)  # at which visit a part is reached
    reached = np.bincount([rank[r["q"], r["part"]] for r in found], [r["n"] for r in found], parts)
    return 1 + int(np.argmax(np.cumsum(reached) >= goal * reached.sum()))


def _topped(score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:top]
    return score[order], ids[order]


def search(df: DataFrame, every: int = EVERY, top: int = TOP, parts: int = PARTS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The nearest rows of each row of (vec_id, embedding) whose vec_id is divisible by `every`."""
    spark = df.sparkSession
    e = F.col("embedding")
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL").filter(F.coalesce(sound, F.lit(False)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(fit_rows + TESTED).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    sizes = [len(r[0]) for r in sample]
    dim = max(set(sizes), key=sizes.count)
    x = np.array([r[0] for r in sample if len(r[0]) == dim])
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    held = min(TESTED, len(x) // 10)
    tested, x = x[:held], x[held:]
    router = fit(x, min(MOST_PARTS, max(parts, -(-rows.count() // BLOCK_ROWS))))
    # repeated rows go before ids are ranked, else they take the places of other ids
    rows = rows.filter(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"])

    # equal vectors are one, with the ids that a list can show; ranked before they are gathered
    keyed = rows.withColumn("_k", F.xxhash64("embedding"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "embedding").orderBy("vec_id"))).filter(F.col("_r") <= top + 1)
    vectors = ranked.groupBy("_k", "embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))

    def route(n: int):
        def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    pdf["part"] = [p.astype(np.int32) for p in router.parts(np.stack(pdf["embedding"].to_numpy()), n)]
                yield pdf if len(pdf) else pdf.assign(part=pd.Series(dtype=object))

        return routed

    index = vectors.select("embedding", "ids").mapInPandas(route(1), "embedding array<double>, ids array<long>, part array<int>")
    index = checkpoint(index.select(F.col("part")[0].alias("part"), "embedding", "ids"))
    # one row a part: bounded by `parts`
    blocks = {r["part"]: max(1, -(-r["n"] // BLOCK_ROWS)) for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not blocks:
        return empty
    count = F.create_map(*[F.lit(v) for kv in sorted(blocks.items()) for v in kv])
    index = index.withColumn("block", F.pmod(F.xxhash64("embedding"), count[F.col("part")]).cast("int"))

    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    asked = asked.mapInPandas(route(visits(index, router, tested, top)), "vec_id long, embedding array<double>, part array<int>")
    asked = asked.withColumn("part", F.explode("part")).filter(F.map_contains_key(count, F.col("part")))
    asked = checkpoint(asked.withColumn("block", F.explode(F.sequence(F.lit(0), count[F.col("part")] - 1))))
    # more queries than one call should hold meet a block's rows in several groups
    groups = max(1, -(-asked.count() // (sum(blocks.values()) * QUERY_ROWS)))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    index = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = c["ids"].to_numpy()
        flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        x, out = np.stack(c["embedding"].to_numpy()), []
        for i in range(0, len(q), 256):
            some = q.iloc[i : i + 256]
            s = np.stack(some["embedding"].to_numpy()) @ x.T
            for own, row in zip(some["vec_id"].to_numpy(), s):
                # the vectors that can be among the nearest, with all that tie at the end
                k = min(top + 1, len(row))
                near = np.flatnonzero(row >= np.partition(row, -k)[-k])
                hit = np.flatnonzero(np.isin(owner, near)) if len(flat) != len(row) else near
                hit = hit[flat[hit] != own]
                score, vec = _topped(row[owner[hit]], flat[hit], top)
                out.append((np.full(len(vec), own), vec, score))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    keys = ["part", "block", "group"]
    found = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
