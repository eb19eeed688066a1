"""Quality rules: repetition coverage of words, n-grams and lines.

Whole texts are handled in numpy, many at once: words get 64-bit hashes, runs of n words get rolling hashes of those, and
runs that occur twice or more within a text cover characters; lines are hashed as byte ranges. The verdict rejects a text of which repeated runs of
5, 7 or 10 words, or repeated lines, cover too large a share of the word characters.

Fixed limits of the verdict (shares of a text's word characters, first occurrence included):
    lines 0.40, 5 words 0.45, 7 words 0.42, 10 words 0.40; symbols for each word 0.2

Defined cases: null or empty text has no words and fails the base rule; a text of any length is measured whole; ties and
repeated rows are judged alike; an empty table gives an empty result; further columns are ignored (``judge`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, buffers, covered, mix, ranges, repeated, slices, sums, table

#: Words of the base window, and least words of a text.
BASE_WINDOW, LEAST_WORDS = 3, 50
#: Largest share of word characters that repeated runs of so many words, or repeated lines, may cover.
MOST_COVERED = {5: 0.45, 7: 0.42, 10: 0.40}
MOST_LINES = 0.40
MOST_SYMBOLS = 0.2

#: Counted as symbols: fixed by contract.
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "line_share double, share_5 double, share_7 double, share_10 double"
)


def lines(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its lines with a word that equal an earlier one, and the word characters of all lines that occur twice or more.

    letters: running sums, over bytes, of the characters that are no white space.
    """
    n = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], cuts]), kind="stable")  # the i-th line begins at the i-th start and ends at the i-th end
    chars = letters[end] - letters[start]
    worded = np.flatnonzero(chars)
    start, end, chars = start[worded], end[worded], chars[worded]
    doc = np.searchsorted(offsets, start, side="right") - 1
    if not len(doc):
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    kind, times = np.unique(ranges(data, start, end) ^ mix(doc.astype(np.uint64)), return_inverse=True, return_counts=True)[1:]
    again = times[kind] > 1
    covered_chars = np.bincount(doc[again], chars[again], n).astype(np.int64)
    first = np.zeros(len(times), dtype=np.int64)
    first[kind] = doc
    return np.bincount(first, times - 1, n).astype(np.int64), covered_chars


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text by name."""
    data, offsets = buffers(texts)
    words = Words(data, offsets)
    n = len(words.start)
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    length = chars[words.end] - chars[words.start]
    out = {"n_words": words.count, "word_chars": sums(length, words.first), "n_symbols": sums(SYMBOLS[data], offsets)}
    hashes = words.hashes()
    doc = words.doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)

    def inside(k: int) -> np.ndarray:
        """Which words are in a run of k words that the text has twice or more."""
        at, runs = words.windows(hashes, k)
        return covered(n, at[repeated(runs ^ doc[at])], k) if len(at) else np.zeros(n, dtype=bool)

    out["n_repeat_words"] = sums(inside(BASE_WINDOW), words.first)
    total = np.maximum(out["word_chars"], 1)
    for k in MOST_COVERED:
        out[f"share_{k}"] = sums(np.where(inside(k), length, 0), words.first) / total
    letters = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data], out=letters[1:])
    out["n_dup_lines"], out["line_share"] = lines(data, offsets, letters)
    out["line_share"] = out["line_share"] / total
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    bad = out["base_failed"] | (out["line_share"] > MOST_LINES) | (out["n_symbols"] > MOST_SYMBOLS * out["n_words"])
    for k, most in MOST_COVERED.items():
        bad |= out[f"share_{k}"] > most
    out["kept"] = ~bad
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = measure(part.column("text"))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id") if x == "doc_id" else pa.array(found[x]) for x in names], names)


def quality(df: DataFrame) -> DataFrame:
    """The measures and the verdict of each row of (doc_id, text)."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, SCHEMA)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part.filter(pa.array(measure(part.column("text"))["kept"]))


def judge(df: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns. Needs a string column `text`."""
    return df.mapInArrow(_kept, df.schema)


def op10_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _each(part: str) -> str:
    """part for each window size, of which SQL has a column each."""
    return ", ".join(part.format(k=k, last=k - 1, most=MOST_COVERED.get(k)) for k in (BASE_WINDOW, *MOST_COVERED))


_BLANK = r"\x20\x09-\x0D"

#: Runs of words are compared as strings.
SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT r, regexp_extract_all(text, '[^{_BLANK}]+') AS w FROM texts)
), runs AS (
  SELECT r, i, length(word) AS chars, max(i) OVER (PARTITION BY r) AS n,
    {_each("string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING) AS run_{k}")} FROM words
), again AS (
  SELECT r, i, chars, {_each("i + {last} <= n AND count(*) OVER (PARTITION BY r, i + {last} <= n, run_{k}) > 1 AS again_{k}")} FROM runs
), inside AS (
  SELECT r, chars, {_each("max(again_{k}::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {last} PRECEDING AND CURRENT ROW) AS in_{k}")} FROM again
), totals AS (
  SELECT r, count(*) AS n_words, sum(chars) AS word_chars, sum(in_{BASE_WINDOW}) AS n_repeat_words, {_each("sum(in_{k} * chars) AS chars_{k}")} FROM inside GROUP BY r
), lines AS (
  SELECT r, line, count(*) AS n, length(regexp_replace(line, '[{_BLANK}]', '', 'g')) AS chars
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^{_BLANK}]') GROUP BY r, line
), repeats AS (
  SELECT r, sum(n - 1) AS n_dup_lines, sum(n * chars) FILTER (n > 1) AS line_chars FROM lines GROUP BY r
), measures AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_chars / word_chars::DOUBLE, 0) AS line_share,
    {", ".join(f"coalesce(chars_{k} / word_chars::DOUBLE, 0) AS share_{k}" for k in MOST_COVERED)}
  FROM texts LEFT JOIN totals USING (r) LEFT JOIN repeats USING (r)
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures
)
SELECT *, NOT (base_failed OR line_share > {MOST_LINES}::DOUBLE OR n_symbols > {MOST_SYMBOLS}::DOUBLE * n_words
  OR {" OR ".join(f"share_{k} > {most}::DOUBLE" for k, most in MOST_COVERED.items())}) AS kept
FROM judged
"""
