"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each source gets a target share of the output. With n rows in the source and T rows wanted in all, a row's number of
copies is Poisson with mean share * T / n: a uniform number from a hash of (seed, row key, part) is put through the
inverse of the distribution. Large means are sums of several parts of mean PART_MEAN at most, which is still Poisson. The
copies are ordered by a hash of (seed, row key, copy): a global shuffle. Those hashes are uniform, so the bounds of the
ranges that partitions hold are known, and nothing is sampled to find them.

A row's key is of its id, a hash of its text, its source, a hash of its other columns, and, among rows that are equal in
all of these, a number from 1. Equal rows are interchangeable, so they are counted, not numbered one by one: counts are
aggregated before the shuffle and dealt out again in blocks of numbers, so that a group of any size is no task of its own.

Defined cases: a null source is a source of its own, named ``(none)``; rows with null or repeated ids, and rows that are
equal in all columns, are rows like others, each with a draw and a place of its own; null text is told apart from empty
text; texts of any length travel whole; an empty table gives an empty result; columns other than doc_id and source are
carried unchanged (those named ``copy`` or ``mix_key`` are replaced).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, restored, table

SEED = 17
#: Share of a source without a stated weight: its number of rows to this power, then scaled to 1 in all.
FLATTEN = 0.5
#: Rows out for each row in.
GROWTH = 1.0
#: Largest mean that is inverted at once; its distribution ends before MOST.
PART_MEAN, MOST = 8.0, 64
#: A table of sources, or of keys that repeat, this small is broadcast; a larger one is joined by shuffle, on salted keys.
BROADCAST_SOURCES, SALTS = 10_000, 64
#: Equal rows that are dealt out as one block.
BLOCK = 4_096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from the MD5 of the parts joined by a colon."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def means(df: DataFrame, weights: Mapping[str, float] | None = None, flatten: float = FLATTEN, growth: float = GROWTH) -> DataFrame:
    """For each source its mean number of copies. One row a source; weights are relative to the other stated ones.

    If weights are given, sources without one get none; otherwise a source of n rows weighs n ** flatten.
    """
    sizes = df.groupBy(F.coalesce(F.col("source"), F.lit("(none)")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is not None:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        stated = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.join(F.broadcast(stated), "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        sizes = sizes.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(flatten)))
    total = lambda c: sizes.agg(F.sum(c)).scalar()
    sizes = sizes.withColumn("all_rows", total("rows")).withColumn("all_weight", total("weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return sizes.select("source", "rows", share.alias("share"), (share * F.col("all_rows") * growth / F.col("rows")).alias("mean"))


def distribution(mean: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... for a mean of PART_MEAN at most."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k.cast("double")).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k.cast("double"))).alias("cdf"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step)["cdf"]


def copies(row_key: Column, parts: Column, cdf: Column, seed: int) -> Column:
    """Poisson counts: for each part, how many of the distribution's steps lie at or below the hash's number."""
    def one(part: Column) -> Column:
        return F.transform(F.array(uniform(F.lit(str(seed)), row_key, part.cast("string"))), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))[0]

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, part: acc + one(part))


def told_apart(df: DataFrame) -> DataFrame:
    """df (doc_id, source, text, _carried; the last two if there are any) with `_key`, another for each row: see above."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null is not empty
    has = lambda c, key: [key] if c in df.columns else []
    parts = [known(F.col("doc_id").cast("string")), *has("text", known(F.md5(F.col("text").cast("string")))), known(F.col("source").cast("string")), *has("_carried", F.xxhash64("_carried").cast("string"))]
    df = df.withColumn("_key", F.concat_ws(":", *parts))
    repeated = df.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    some = len(repeated.take(BROADCAST_SOURCES + 1))
    one = F.concat("_key", F.lit(":1"))
    if not some:
        return df.withColumn("_key", one)
    side = F.broadcast(repeated) if some <= BROADCAST_SOURCES else repeated
    alone = df.join(side, "_key", "left_anti").withColumn("_key", one)
    again = df.join(side, "_key", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    # at most one row for BLOCK rows and each distinct one is dealt anew before numbers are given
    again = again.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {BLOCK}")))).repartition("_key", "_b")
    again = again.withColumn("_i", F.explode(F.sequence(F.col("_b") * BLOCK + 1, F.least(F.col("_n"), (F.col("_b") + 1) * BLOCK))))
    return alone.unionByName(again.withColumn("_key", F.concat_ws(":", "_key", "_i")).drop("_n", "_b", "_i"))


def in_order(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """rows in the order of a column of hex digits that are uniform: partition i holds the i-th of equal ranges of its first 8."""
    place = F.expr(f"(conv(substr({key}, 1, 8), 16, 10) * {partitions}L) div {1 << 32}L").cast("int")
    return rows.repartitionById(partitions, place).sortWithinPartitions(key)


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, seed: int = SEED, flatten: float = FLATTEN, growth: float = GROWTH) -> DataFrame:
    """df with each row repeated by its Poisson count, `copy` from 1, in the order of `mix_key`."""
    df, own = df.drop("copy", "mix_key"), ("doc_id", "source", "text")
    names, df = df.columns, carried(df, *own)
    plan = means(df, weights, flatten, growth)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / PART_MEAN).cast("int"))
    plan = plan.withColumn("_parts", parts).withColumn("_cdf", distribution(F.col("mean") / F.col("_parts")))
    plan = plan.select(F.col("source").alias("_source"), "_parts", "_cdf")
    rows = told_apart(df).withColumn("_source", F.coalesce(F.col("source"), F.lit("(none)")))
    if len(plan.select("_source").take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(plan), "_source")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
        rows = rows.join(plan.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_source", "_salt"]).drop("_salt")
    key = F.col("_key")
    rows = rows.withColumn("_copies", copies(key, F.col("_parts"), F.col("_cdf"), seed)).filter("_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_source", "_parts", "_cdf", "_copies")
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order {seed}"), key, F.col("copy").cast("string")))).drop("_key")
    rows = rows.select(*restored(names, *own), "copy", "mix_key")
    return in_order(rows, "mix_key", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '(none)') AS s, count(*) AS n, pow(count(*)::DOUBLE, {FLATTEN}) AS w FROM documents GROUP BY 1
), plan AS (
  SELECT s, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) * {GROWTH} / n AS mean FROM sizes
), parts AS (
  SELECT s, greatest(1, ceil(mean / {PART_MEAN}))::INT AS m, mean / greatest(1, ceil(mean / {PART_MEAN}))::INT AS mean FROM plan
), cdf(s, m, mean, k, p, c) AS (
  SELECT s, m, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT s, m, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {MOST}
), keyed AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, coalesce('=' || doc_id::VARCHAR, '') || ':' || coalesce('=' || md5(text), '') || ':' || coalesce('=' || source, '')
    || ':' || (row_number() OVER (PARTITION BY doc_id, text, source))::VARCHAR AS k FROM documents
), draws AS (
  SELECT d.r, d.k, d.doc_id, d.source, d.text, p.s, i.i, ('0x' || substr(md5('{SEED}:' || d.k || ':' || i.i::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
  FROM keyed d JOIN parts p ON p.s = coalesce(d.source, '(none)'), LATERAL (SELECT unnest(range(1, p.m + 1)) AS i) i
), counts AS (
  SELECT r, any_value(k) AS k, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(text) AS text,
    sum((SELECT count(*) FROM cdf c WHERE c.s = x.s AND c.c <= x.u))::BIGINT AS n
  FROM draws x GROUP BY r
)
SELECT doc_id, source, c::INT AS copy, md5('order {SEED}:' || k || ':' || c::VARCHAR) AS mix_key, text
FROM (SELECT *, unnest(range(1, n + 1)) AS c FROM counts WHERE n > 0)
"""
