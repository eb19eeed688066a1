"""The pipeline's stages against plain restatements, and the registered queries."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline as pipeline
from corpusloom.llm import queries, quality, secrets


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage returns, written and read again as the next one's documents."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(stages):
    want = {r["doc_id"] for r in stages[0].collect() if brute.quality(r["text"], quality.MOST_COVERED, quality.MOST_LINES, quality.MOST_SYMBOLS)["kept"]}
    assert {r["doc_id"] for r in stages[1].collect()} == want


def test_near_duplicates(stages):
    data = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {c for _, _, c in brute.jaccard_components(data, pipeline.WORDS, pipeline.SIMILARITY, 100)}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(want)


def test_secrets(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        text, at, out = before.pop(r["doc_id"]), 0, ""
        for a, _, b in brute.secret_spans(text, secrets.CLASSES, secrets.WINDOW)[1]:
            out += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])
    assert not before


def test_mixing(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert set(got) <= set(texts) and 0.6 * len(texts) < sum(got.values()) < 1.4 * len(texts)
    assert all(texts[r["doc_id"]] == r["text"] for r in stages[4].collect())


def test_tokens(stages):
    assert {r["doc_id"] for r in stages[5].collect()} == {r["doc_id"] for r in stages[4].collect()}


def test_odd_rows(spark, sf):
    text = " ".join(f"word{i}" for i in range(80))
    secret = "token=abcdefghijklmnop"
    rows = [(None, text, None, None, None), (None, text, "x", "s", 1), (1, text + " more", None, "s", 1), (1, text, None, "s", 1), (2, None, None, None, None), (3, "", "", "", 0), (4, f"{text.upper()[::-1]} {secret}", None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit("clash"))
    seen = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen.append(docs.collect())
    assert sorted((r["doc_id"] or 0) for r in seen[0]) == [0, 0, 1, 1, 4]
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(r["doc_id"] for r in seen[2]) == [1, 4]
    assert [r["text"] for r in seen[2] if r["doc_id"] == 4] == [text.upper()[::-1] + " [SECRET]"]
    times = Counter(r["doc_id"] for r in seen[3])
    assert set(times) <= {1, 4} and all(r["_key"] == "clash" for s in seen[:4] for r in s)
    # two distinct samples of each copy
    assert Counter(r["doc_id"] for r in seen[4]) == {d: 2 * n for d, n in times.items()} and {r["sample"] for r in seen[4]} <= {1, 2}


def test_unlinked_texts_under_one_id(spark, sf):
    text = lambda name: " ".join(f"{name}{i}" for i in range(80))
    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (7, text("c")), (3, text("c") + " more"), (7, text("d") + " more"), (7, text("d")), (None, text("e")), (None, text("f")), (None, text("a")), (7, None), (7, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, sf).collect()]
    one_of = [r for r in got if r[1] and r[1].startswith("d0 ")]
    assert len(one_of) == 1 and one_of[0][0] == 7
    want = [(7, text("a")), (7, text("b")), (3, text("c") + " more"), (None, text("e")), (None, text("f")), (7, None), (7, "")]
    assert sorted(got, key=repr) == sorted(want + one_of, key=repr)


def test_rows_without_ids_are_mixed_one_by_one(spark, sf):
    rows = [(None, f"null {i}", "null") for i in range(2000)] + [(5, f"five {i}", "five") for i in range(2000)] + [(None, "same", "same")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    got = [(r["lang"], r["text"]) for r in pipeline.mix_sources(spark, docs, sf).collect()]
    for name in ("null", "five", "same"):
        assert abs(sum(g[0] == name for g in got) - 2000) < 5 * 2000**0.5
    for name in ("null", "five"):
        assert len(set(Counter(g for g in got if g[0] == name).values())) > 2
    assert sum(a[0] == b[0] for a, b in zip(got, got[1:])) < 0.4 * len(got)


def test_run(spark, sf):
    assert pipeline.run(spark, sf).columns[:2] == ["doc_id", "sample"]


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(entry.queries()) >= {*names, "pipeline"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    want = want.astype({c: float for c in want.columns if str(want[c].dtype).startswith("Int")})  # integers with nulls, as the other side gives them
    plain = lambda d: sorted(tuple(map(str, r)) for r in d[columns].itertuples(index=False))
    assert columns == sorted(want.columns) and plain(got) == plain(want)
