"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Law: ``rows``. A row's number is its rank in a fixed order of the whole table; a keyed bijection of 0 .. n - 1 turns it
into a place; shard and slot are the place modulo and divided by the number of shards. So shard sizes differ by one row
at most, slots have no gaps, the order is reproducible from the seed, and (shard, slot) of a row number can be computed
without the table (`place`), as can the row number of a (shard, slot) pair (`row_at`).

Row numbers without one big sort: equal rows are counted (aggregated before the shuffle) and numbered as a range; these
ranges go to buckets by hash, a small table of bucket sizes (`buckets` rows, whatever the input) gives each bucket's first
number, and ranges follow each other within their bucket. A range of any size is dealt out in blocks of BLOCK numbers, so
that a group of equal rows is no task of its own.

Defined cases: null text counts as no bytes, like empty text; null ids are ordinary rows; rows of one id and text are
interchangeable and get different places; texts of any length count whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 40
SEED = 20_260_101
ROUNDS = 6
#: Buckets of the row numbering: each is ranked by one task.
BUCKETS = 4096
#: Numbers of a range that are dealt out at once.
BLOCK = 4096
#: A walk that is still outside after so many steps fails the query (odds below 2 ** -STEPS each).
STEPS = 128
#: The modulus of the round function, 2 ** 31 - 1.
PRIME = 2_147_483_647


def keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round, from a linear congruence on the seed."""
    out, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 48_271 + 11) % PRIME
        a = x | 1
        x = (x * 48_271 + 11) % PRIME
        out.append((a, x))
    return out


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and the right half of the smallest even split whose domain holds n values."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _scatter(r, a: int, b: int):
    """The round function; its values stay below 2 ** 62. Works on Python integers and on columns alike."""
    t = (r * a + b) % PRIME
    return (t * t + t + a % 65_521) % PRIME


def permute(x: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """Where x of 0 .. n - 1 goes, in plain Python."""
    lo, hi = halves(n)
    while True:
        left, right, wl, wr = x >> hi, x & ((1 << hi) - 1), lo, hi
        for a, b in keys(seed, rounds):
            left, right = right, left ^ (_scatter(right, a, b) & ((1 << wl) - 1))
            wl, wr = wr, wl
        x = (left << wr) | right
        if x < n:
            return x


def unpermute(y: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """The inverse of `permute`."""
    lo, hi = halves(n)
    ks = keys(seed, rounds)
    while True:
        wl, wr = (lo, hi) if rounds % 2 == 0 else (hi, lo)
        left, right = y >> wr, y & ((1 << wr) - 1)
        for a, b in reversed(ks):
            left, right = right ^ (_scatter(left, a, b) & ((1 << wr) - 1)), left
            wl, wr = wr, wl
        y = (left << hi) | right
        if y < n:
            return y


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard and slot."""
    return unpermute(slot * shards + shard, n, seed)


def _step(x: Column, n: int, seed: int, rounds: int) -> Column:
    """One pass of the Feistel network over a column of numbers."""
    lo, hi = halves(n)
    turns, wl, wr = [], lo, hi
    for a, b in keys(seed, rounds):
        turns.append(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit((1 << wl) - 1).cast("long").alias("mask")))
        wl, wr = wr, wl
    start = F.struct(F.shiftright(x, hi).alias("l"), x.bitwiseAND(F.lit((1 << hi) - 1).cast("long")).alias("r"))
    turn = lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_scatter(s["r"], k["a"], k["b"]).bitwiseAND(k["mask"])).alias("r"))
    return F.aggregate(F.array(*turns), start, turn, lambda s: F.shiftleft(s["l"], wr).bitwiseOR(s["r"]))


def permuted(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """`permute` as a column expression: walk until inside, for STEPS steps at most, else fail."""
    walk = lambda acc, i: F.when((i > 0) & (acc < n), acc).otherwise(_step(acc, n, seed, rounds))
    checked = lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), x.cast("long"), walk, checked)


def _hash(order: list[str]) -> Column:
    """32 bits of an MD5 sum, which SQL engines agree on. Nulls are left out: equal hashes only share a bucket."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order])), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, order: list[str], buckets: int = BUCKETS, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The order columns of df with `row_no`, each row's rank from 0 by (hash of the order columns, order columns), and the number of rows."""
    df = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", _hash(order) % buckets)
    # at most `buckets` rows, whatever the input: a fixed bound, so they may be ranked in one task and broadcast
    counts = df.groupBy("_bucket").agg(F.sum("_n").alias("_n"), F.max("_n").alias("_most")).collect()
    first, total = {}, 0
    for r in sorted(counts, key=lambda r: r["_bucket"]):
        first[r["_bucket"]] = total
        total += r["_n"]
    firsts = df.sparkSession.createDataFrame(sorted(first.items()), "_bucket long, _first long")
    before = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_before", F.coalesce(before, F.lit(0))).join(F.broadcast(firsts), "_bucket")
    out = out.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {block}"))))
    if any(r["_most"] > block for r in counts):
        out = out.repartition(*order, "_block")
    out = out.withColumn("_at", F.explode(F.sequence(F.col("_block") * block, F.least(F.col("_n"), (F.col("_block") + 1) * block) - 1)))
    return out.select(*order, (F.col("_first") + F.col("_before") + F.col("_at")).alias("row_no")), total


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """row_no, shard and slot for each row of (doc_id, text), with size, CRC-32 and MD5 sum of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("text_hash"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size", "text_hash"])
    at = rows.withColumn("_place", permuted(F.col("row_no"), max(n, 1), seed))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod(F.col("_place"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no", "text_hash",
    )


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _nibble(crc: int) -> int:
    for _ in range(4):
        crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    return crc


def _sql() -> str:
    """The query in DuckDB's SQL: CRC-32 by half bytes, row numbers by one sort, and the walk as a recursion."""
    steps = f"[{', '.join(str(_nibble(i)) for i in range(16))}]"
    low = f"xor(xor(c, b) >> 4, {steps}[(xor(c, b) & 15) + 1])"
    crc = f"xor(({low}) >> 4, {steps}[(({low}) & 15) + 1])"
    turn = "SELECT row_no, step, lo, hi, p >> hi AS l, p & ((1::BIGINT << hi) - 1) AS r FROM walk CROSS JOIN size WHERE step = 0 OR p >= n"
    for i, (a, b) in enumerate(keys(SEED, ROUNDS)):
        mask = f"((1::BIGINT << {('lo', 'hi')[i % 2]}) - 1)"
        turn = f"SELECT row_no, step, lo, hi, r AS l, xor(l, ((t * t + t + {a % 65_521}) % {PRIME}) & {mask}) AS r FROM (SELECT *, (r * {a} + {b}) % {PRIME} AS t FROM ({turn}))"
    return f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), sums AS (
  SELECT doc_id, octet_length(encode(text))::BIGINT + 16 AS size, md5(text) AS text_hash, xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: {crc}, 4294967295::BIGINT)) AS text_crc32
  FROM texts
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', doc_id, text_crc32, size, text_hash)), 1, 8))::BIGINT % {BUCKETS},
    doc_id NULLS FIRST, text_crc32, size, text_hash) - 1 AS row_no FROM sums
), size AS (
  SELECT n, bits // 2 AS lo, bits - bits // 2 AS hi FROM (SELECT count(*) AS n, greatest(2, length(bin(greatest(count(*), 1) - 1))) AS bits FROM numbered)
), walk(row_no, p, step) AS (
  SELECT row_no, row_no, 0 FROM numbered
  UNION ALL
  SELECT row_no, (l << {('hi', 'lo')[ROUNDS % 2]}) | r, step + 1 FROM ({turn})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {SHARDS})::INT AS shard, (p // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, row_no, text_hash
FROM numbered JOIN walk USING (row_no) CROSS JOIN (SELECT n FROM size) WHERE step > 0 AND p < n
"""


SQL = _sql()
