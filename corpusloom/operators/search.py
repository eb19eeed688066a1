"""Exact vector search with scopes, graph expansion, and recall by score band."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vector
from ..sources.corpus import COLLECTION, GLOBAL

#: Points and queries that one task compares, queries whose products with all points of a task are held at once, and pairs whose exact products are.
POINT_ROWS, QUERY_ROWS, AT_ONCE, PAIRS = 16_384, 4_096, 256, 65_536
KINDS = ("doc", "notes", "session")


def _blocks(df: DataFrame, key: str, name: str, rows: int) -> tuple[DataFrame, int]:
    """df dealt by hash into blocks of about so many rows, and their number: it grows with the table."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _leading(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: list[np.ndarray], k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of x and cosines of the k best for each row of q, ties to smaller ids; own: rows of x that are none for it.

    Products in single precision leave all that can be among the k best, by the bound on their error; of these they are
    taken anew in double precision, each by itself, so that equal vectors tie.
    """
    m, d = x.shape
    n = min(k, m)
    size = max(1, min(64, m // (4 * n)))
    groups = -(-m // size)
    y = np.zeros((groups * size, d), dtype=np.float32)
    y[:m] = x
    margin = np.float32(4 * (d + 8) * 2.0**-24)
    finite = np.isfinite(x).all() and np.isfinite(q).all()
    out = []
    for i in range(0, len(q), AT_ONCE):
        s = q[i : i + AT_ONCE].astype(np.float32) @ y.T
        s[:, m:] = -np.inf
        if not finite:
            s[~np.isfinite(s)] = -np.inf
        for r, at in enumerate(own[i : i + AT_ONCE]):
            s[r, at] = -np.inf
        # n groups have a product of this bound or more, so the n-th best has
        bound = np.partition(s.reshape(len(s), size, groups).max(axis=1), -n, axis=1)[:, -n]
        r, c = np.nonzero(s >= (bound - margin)[:, None])
        there = s[r, c] > -np.inf
        r, c = r[there], c[there]
        exact = np.concatenate([np.einsum("ij,ij->i", q[i + r[j : j + PAIRS]], x[c[j : j + PAIRS]]) for j in range(0, max(1, len(r)), PAIRS)])
        r, c, exact = r[exact >= least], c[exact >= least], exact[exact >= least]
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((i + r[first], c[first], exact[first]))
    return tuple(np.concatenate(a) for a in zip(*out))


def _same(ids: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """For each of own the places where ids has it; none for nulls."""
    codes = pd.factorize(np.concatenate([ids.astype(object), own.astype(object)]))[0]
    have, want = codes[: len(ids)], codes[len(ids) :]
    order = np.argsort(have, kind="stable")
    ends = zip(want, np.searchsorted(have[order], want), np.searchsorted(have[order], want, "right"))
    return [order[a:b] if code >= 0 else order[:0] for code, a, b in ends]


def nearest(points: DataFrame, queries: DataFrame, k: int, *, key: str = "id", least: float | None = None) -> DataFrame:
    """The k best points (id, vector) of each query (query_id, query), by cosine, ties to smaller ids; never the query itself.

    Both sides are dealt into blocks by their number of rows; each block of queries meets each block of points once, as a
    matrix product, and only the k best of it are shuffled on. Exact, so the work is the product of both numbers of rows. Zero vectors and vectors of other lengths have no cosine.
    """
    vectors = lambda df, c: df.withColumn("_v", vector.normalised(F.col(c))).filter("_v[0] IS NOT NULL").withColumn("_d", F.size("_v"))
    p = vectors(points, "vector").drop("vector")
    q = vectors(queries.select("query_id", "query"), "query").drop("query")
    (p, np_), (q, nq) = _blocks(p, key, "_bp", POINT_ROWS), _blocks(q, "query_id", "_bq", QUERY_ROWS)
    carried = [f for f in p.schema.fields if f.name not in ("_v", "_d", "_bp")]
    names = [f.name for f in carried]
    schema = T.StructType([*carried, queries.schema["query_id"], T.StructField("score", T.DoubleType())])

    def best(some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(rows):
            return pd.DataFrame(columns=schema.names)
        ids, own = rows[key].to_numpy(), some["query_id"].to_numpy()
        r, c, score = _leading(_matrix(some["_v"]), _matrix(rows["_v"]), ids, _same(ids, own), k, -np.inf if least is None else least)
        return rows.iloc[c][names].assign(query_id=own[r], score=score)

    keys = ["_d", "_bp", "_bq"]
    found = q.withColumn("_bp", _every(np_)).groupBy(*keys).cogroup(p.withColumn("_bq", _every(nq)).groupBy(*keys)).applyInPandas(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(points: DataFrame, query: list[float], k: int = 5, key: str = "id") -> DataFrame:
    """The k best points for one vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return points.withColumn("score", vector.cosine(F.col("vector"), q)).filter("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


def top_k_visual(points: DataFrame, query: list[list[float]], k: int = 5, key: str = "id") -> DataFrame:
    """The k best pages (id, vectors) for a query of several vectors, by late interaction."""
    q = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in query])
    return points.withColumn("score", vector.max_sim(q, F.col("vectors"))).orderBy(F.desc("score"), key).limit(k)


def merged(hits: Iterable[DataFrame], k: int, key: str = "id") -> DataFrame:
    """The k best of several collections' hits."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits).orderBy(F.desc("score"), key).limit(k)


def hits(found: DataFrame, excerpt: int = 300) -> DataFrame:
    """score (4 places), source, excerpt and type of found points."""
    return found.select(F.round("score", 4).alias("score"), text.label(F.col("file_path"), F.col("slug")).alias("source"), F.left(F.col("text"), F.lit(excerpt)).alias("excerpt"), F.lit("text").alias("type"))


def suggestions(points: DataFrame, queries: DataFrame, k: int = 6, least: float = 0.85) -> DataFrame:
    """For documents without related entries: nearest others of the first k that reach a score, empty sources dropped."""
    found = nearest(points, queries, k)
    return found.filter((F.col("score") >= least) & (F.coalesce("source", F.lit("")) != "")).withColumn("score", F.round("score", 4))


def near_duplicates(points: DataFrame, least: float = 0.92) -> DataFrame:
    """Pairs of points above a cosine, the smaller id first. Blocks of points meet as matrix products; each pair is compared once."""
    v = points.select("id", vector.normalised(F.col("vector")).alias("v")).filter("v[0] IS NOT NULL").withColumn("d", F.size("v"))
    v, n = _blocks(v, "id", "b", QUERY_ROWS)
    kind = points.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType())])

    def above(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.names)
        ids, others, x, out = left["id"].to_numpy(), right["other"].to_numpy(), _matrix(right["w"]), []
        for i in range(0, len(left), AT_ONCE):
            s = _matrix(left["v"].iloc[i : i + AT_ONCE]) @ x.T
            r, c = np.nonzero(s > least)
            one, two = ids[i + r], others[c]
            keep = one < two if key[1] == key[2] else one != two
            out.append(pd.DataFrame({"a": np.minimum(one, two)[keep], "b": np.maximum(one, two)[keep], "score": s[r, c][keep]}))
        return pd.concat(out)

    left = v.select("id", "v", "d", F.col("b").alias("x"), F.explode(F.sequence(F.col("b"), F.lit(n - 1))).alias("y"))
    right = v.select(F.col("id").alias("other"), F.col("v").alias("w"), F.col("d").alias("d"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("x"), F.col("b").alias("y"))
    return left.groupBy("d", "x", "y").cogroup(right.groupBy("d", "x", "y")).applyInPandas(above, schema)


def project_of(name: Column) -> Column:
    """The project of a collection; `GLOBAL` for global ones; null for other names."""
    return F.when(name.rlike(rf"^{GLOBAL}_(doc|notes|session|visual)$"), GLOBAL).when(name.rlike(COLLECTION), F.regexp_extract(name, COLLECTION, 2))


def permitted(collections: DataFrame, current: str, mode: str = "all", projects: Iterable[str] = ()) -> DataFrame:
    """Collections that a project may recall from: its own and global ones always; others by include or exclude lists."""
    project, own = project_of(F.col("name")), [current, GLOBAL]
    if mode == "include":
        return collections.filter(project.isin([*own, *projects]))
    if mode == "exclude":
        return collections.filter(project.isin(own) | ~F.coalesce(project.isin(list(projects)), F.lit(False)))
    return collections


def scope(project: str, kind: str = "repo", visual: bool = False, shared: Mapping | None = None, discovered: Iterable[str] = ()) -> list[str]:
    """Names to be searched for a scope: the project's own, shared (as configured), or global ones."""
    own = [f"{project}_{k}" for k in KINDS] + ([f"{project}_visual"] if visual else [])
    if kind == "repo":
        return own
    if kind == "global":
        return [f"{GLOBAL}_{k}" for k in KINDS]
    if kind != "shared":
        raise ValueError("scope must be repo, shared or global")
    if not (shared or {}).get("enabled"):
        return [f"{project}_{k}" for k in (*KINDS, "visual")]
    return list(discovered)


def route(doc_type: Column, project: str) -> Column:
    """The collection of a kind of document."""
    kind = F.when(protected(doc_type), "notes").when(doc_type == "session", "session").otherwise("doc")
    return F.concat(F.lit(f"{project}_"), kind)


def protected(doc_type: Column) -> Column:
    return F.coalesce(doc_type.isin("quirk", "bug-note", "helpful-note"), F.lit(False))


def zones(found: DataFrame, low: float = 0.60, high: float = 0.85) -> DataFrame:
    """For each query its best score and what follows: inject above high, none below low, a judge in between."""
    top = found.groupBy("query_id").agg(F.max("score").alias("top_score"))
    return top.withColumn("zone", F.when(F.col("top_score") > high, "inject").when(F.col("top_score") < low, "none").otherwise("judge"))


def context_block(found: DataFrame, header: str = "Relevant context", excerpt: int = 200) -> DataFrame:
    """For each query one JSON text with a line for each hit, best first."""
    line = F.format_string("- %s (%.2f): %s", F.col("source"), F.col("score"), F.left(F.col("excerpt"), F.lit(excerpt)))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "source", line.alias("line"))))
    body = F.concat_ws("\n", F.lit(header), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"))
    return found.groupBy("query_id").agg(F.to_json(F.struct(body.alias("additionalContext"))).alias("block"))


Judge = Callable[[str, list[str]], bool]


def judged(asked: DataFrame, judge: Judge, prompt: int = 300, excerpt: int = 200) -> DataFrame:
    """query_id and whether a judge finds any of the excerpts relevant, for rows (query_id, prompt, excerpts), in batches.

    A judge that fails says no; one that runs out of time (TimeoutError) lets the hits through.
    """

    def call(text: str | None, found: list[str]) -> bool:
        try:
            return bool(judge((text or "")[:prompt], [(x or "")[:excerpt] for x in found]))
        except TimeoutError:
            return True
        except Exception:  # whatever a model's client raises
            return False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"query_id": pdf["query_id"], "relevant": [call(t, list(x)) for t, x in zip(pdf["prompt"], pdf["excerpts"])]})

    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.select("query_id", "prompt", "excerpts").mapInPandas(run, f"query_id {kind}, relevant boolean")


def recall(points: DataFrame, prompts: DataFrame, judge: Judge, *, current: str, mode: str = "all", projects: Iterable[str] = (), k: int = 5, low: float = 0.60, high: float = 0.85) -> DataFrame:
    """A context block for each prompt (query_id, prompt, query) that has one.

    points: id, vector, collection, file_path, slug, text. Permitted collections are searched; prompts whose best score is
    below `low` get nothing, those above `high` their hits, and a judge decides on the rest.
    """
    names = permitted(points.select(F.col("collection").alias("name")).distinct(), current, mode, projects)
    found = nearest(points.join(names.select(F.col("name").alias("collection")), "collection", "left_semi"), prompts, k)
    found = found.withColumn("source", text.label(F.col("file_path"), F.col("slug"))).withColumn("excerpt", F.left(F.col("text"), F.lit(300)))
    zone = zones(found, low, high)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))), lambda x: x["excerpt"])
    asked = found.groupBy("query_id").agg(ordered.alias("excerpts")).join(zone.filter("zone = 'judge'"), "query_id").join(prompts.select("query_id", "prompt"), "query_id")
    let_through = zone.filter("zone = 'inject'").select("query_id").unionByName(judged(asked, judge).filter("relevant").select("query_id"))
    return context_block(found.join(let_through, "query_id", "left_semi"))
