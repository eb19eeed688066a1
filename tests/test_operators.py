"""Operators on small inputs."""

from __future__ import annotations

import math
import random
from pathlib import PurePosixPath

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import ids, text, time, vector
from corpusloom.operators import audit, checks, chunking, graph, lifecycle, models, pages, search, store
from corpusloom.sources import corpus
from corpusloom.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s, n", [("hello world", 3), ("", 1), ("x" * 30, 10)])
def test_token_estimate(spark, s, n):
    assert chunking.tokens(s) == n == one(spark, text.estimate_tokens(F.lit(s)))


@pytest.mark.parametrize("name, slug", [("My File_v2.pdf", "my-file-v2"), ("--a  b--.md", "a-b"), ("dir/x.tar.gz", "x-tar")])
def test_slug(spark, name, slug):
    assert one(spark, text.slug(F.lit(name))) == slug


@pytest.mark.parametrize("path, kind", [("docs/datasheets/a.pdf", "datasheet"), ("docs/specs/guides/a.pdf", "guide"), ("specs/x/a.pdf", "spec"), ("a.pdf", "unknown")])
def test_doc_type(spark, path, kind):
    assert one(spark, text.doc_type(F.lit(path))) == kind


@pytest.mark.parametrize("s", ["Fig. 3", "Figure 12", "see plot 4", "Chart 1 shows voltage", "diagram 7", "graph 2", "FIG. 1"])
def test_captions(spark, s):
    assert one(spark, text.has_caption(F.lit(s)))


@pytest.mark.parametrize("s", ["configured the system", "figment of imagination", "figure of speech", "reconfigured", "charted course"])
def test_no_captions(spark, s):
    assert not one(spark, text.has_caption(F.lit(s)))


@pytest.mark.parametrize("path, out", [("node_modules/a.md", True), ("x/node_modules/a.md", True), ("a.tmp", True), ("x/y.tmp", True), ("docs/a.md", False)])
def test_excluded(spark, path, out):
    assert one(spark, text.excluded(F.lit(path), ["node_modules/", ".venv/", "*.tmp"])) == out


def test_hash_reads_line_ends_alike(spark):
    a, b = (one(spark, ids.file_hash(F.lit(s).cast("binary"), F.lit("a.md"))) for s in ("x\r\ny", "x\ny"))
    assert a == b and len(a) == 64
    assert one(spark, ids.file_hash(F.lit("x\r\ny").cast("binary"), F.lit("a.PDF"))) != a


def test_point_ids_differ(spark):
    i = [one(spark, c) for c in (ids.point_id(F.lit("a"), F.lit(0)), ids.point_id(F.lit("a"), F.lit(1)), ids.point_id_versioned(F.lit("a"), F.lit(0), F.lit(2)), ids.visual_point_id(F.lit("a"), F.lit(0)))]
    assert len(set(i)) == 4 and all(len(x) == 36 for x in i)


def test_dates(spark):
    assert one(spark, time.iso_date(F.lit("2026-1-2"))) is None
    assert str(one(spark, time.iso_date(F.lit("2026-01-02")))) == "2026-01-02"


def test_version_numbers(spark):
    assert one(spark, text.version_numbers(F.lit("0.3.15rc1"))) == [0, 3, 15]
    assert one(spark, text.version_numbers(F.lit("a.b"))) == [0]


def test_lfs(spark):
    assert one(spark, ids.is_lfs_pointer(F.lit("version https://git-lfs.github.com/spec/v1\noid").cast("binary")))


def test_max_sim(spark):
    q, p = (F.array(*[F.array(*map(F.lit, v)) for v in m]) for m in ([[1.0, 0.0], [0.0, 2.0]], [[0.5, 0.0], [0.1, 0.3]]))
    assert one(spark, vector.max_sim(q, p)) == pytest.approx(0.5 + 0.6)


@pytest.mark.parametrize("length, images, x, body, kind", [
    (200, [], [], "", "pure_text"), (4, [], [], "", "flattened"), (0, [], [], "", "flattened"),
    (200, [], [10.0] * 3 + [200.0] * 3, "", "structured_text"), (200, [(200.0, 200.0)], [10.0] * 3 + [200.0] * 3, "", "structured_text"),
    (200, [(200.0, 200.0)], [], "", "text_with_images"), (200, [(72.0, 36.0)], [], "", "pure_text"),
    (300, [], [], "See Figure 3 ", "text_with_images"), (650, [], [], "See Figure 12 ", "pure_text"),
])
def test_page_class(spark, length, images, x, body, kind):
    s = body + "a" * max(0, length - len(body))
    df = spark.createDataFrame([(s, images, x, 595.0, 842.0)], "text string, images array<struct<w:double,h:double>>, block_x array<double>, page_w double, page_h double")
    assert pages.profiles(df).first()["page_class"] == kind


@pytest.mark.parametrize("body, most, overlap, low, high", [("short text here", 800, 0.15, 1, 1), ("word " * 200, 10, 0.0, 2, 200), ("x" * 10_000 + " word" * 50, 10, 0.5, 2, 499), ("word " * 80, 5, 0.6, 2, 999), ("word " * 200, 5, 0.8, 2, 499), ("word " * 5000, 800, 0.5, 2, 99)])
def test_chunking_ends(body, most, overlap, low, high):
    got = chunking.chunk_pages([(1, body.strip(), [])], most, overlap)
    assert low <= len(got) <= high and [c[0] for c in got] == list(range(len(got))) and all(c[3].strip() for c in got)


def naive_estimate(words):
    s = " ".join(words)
    return max(1, int(max(len(s.split()) * 1.3, len(s) / 3)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("abcdefg", min_size=1, max_size=9), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(3, 40), st.sampled_from([0.0, 0.15, 0.5]))
def test_chunks_hold_every_word_in_order(paragraphs, most, overlap):
    # numbered, so that each word's place in the text is known from the word
    numbers = iter(range(10**6))
    paragraphs = [[f"{w}{next(numbers)}" for w in p] for p in paragraphs]
    body = "\n\n".join(" ".join(p) for p in paragraphs)
    got = chunking.chunk_pages([(1, body, [])], most, overlap)
    want, rest = [w for p in paragraphs for w in p], []
    if len(got) == 1 and got[0][3] == body:
        return
    for _, _, _, chunk in got:
        words = chunk.split()
        k = next(k for k in range(min(len(rest), len(words)), -1, -1) if rest[len(rest) - k :] == words[:k] and want[: len(rest) + len(words) - k] == rest + words[k:])
        rest = rest + words[k:]
    assert rest == want


def test_pages_keep_numbers_and_headings():
    got = chunking.chunk_pages([(1, "a", ["Introduction"]), (2, "b", [])], 800)
    assert [(c[1], c[2]) for c in got] == [(1, "Introduction"), (2, "")]


def test_transcripts():
    assert chunking.chunk_transcript("") == []
    assert len(chunking.chunk_transcript("Alice: " + "word " * 100, 10)) > 1


def test_tables_stay_whole():
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert chunking.split_tables(f"intro\n\n{table}\n\noutro") == [("intro", table), ("outro", "")]
    assert chunking.chunk_structured(f"intro\n\n{table}\n\nmiddle\n\n{table}", 5) == [("text", "intro"), ("table", table), ("text", "middle"), ("table", table)]
    assert chunking.split_tables("plain") == [("plain", "")]


@pytest.mark.parametrize("sizes, kinds, runs", [((10, 15, 5), "ttt", 1), ((200, 5), "Tt", 2), ((100, 5), "tt", 1), ((5, 60, 5), "ttt", 2)])
def test_merge_small(spark, sizes, kinds, runs):
    rows = [(1, i, "table" if k == "T" else "text", f"c{i}", i, f"h{i}", n) for i, (n, k) in enumerate(zip(sizes, kinds))]
    df = spark.createDataFrame(rows, "doc_id int, chunk_index int, chunk_type string, text string, page int, heading string, estimated_tokens int")
    got = chunking.merge_small(df).orderBy("chunk_index").collect()
    assert len(got) == runs and sum(r["estimated_tokens"] for r in got) == sum(sizes)


def walk(seeds, links, most):
    """Breadth first, one document at a time."""
    seen, queue, out = set(seeds), [], []
    for s in seeds:
        for d in links.get(s, []):
            if d not in seen:
                seen.add(d)
                queue.append((d, 1, s))
    while queue:
        d, hop, via = queue.pop(0)
        out.append((d, hop, via))
        for e in links.get(d, []) if hop < most else []:
            if e not in seen:
                seen.add(e)
                queue.append((e, hop + 1, d))
    return sorted(out)


@pytest.mark.parametrize("links, seeds, most", [
    ({"A": ["B", "C"], "B": ["D"], "C": ["D"]}, ["A"], 2), ({"A": ["B"], "B": ["A"]}, ["A"], 1), ({"A": ["C"], "B": ["D"]}, ["A", "B"], 1), ({"A": ["B"], "B": ["C"], "C": ["A"]}, ["A"], 5),
    (None, None, 3),
])
def test_hops(spark, links, seeds, most):
    if links is None:
        rnd = random.Random(8)
        links, seeds = {str(i): rnd.sample([str(j) for j in range(25)], 3) for i in range(25)}, ["3", "14"]
    e = spark.createDataFrame([(s, d, p) for s, ds in links.items() for p, d in enumerate(ds)], "src string, dst string, pos int")
    s = spark.createDataFrame([(d, i) for i, d in enumerate(seeds)], "doc string, seed_no int")
    assert sorted(tuple(r) for r in graph.hops(e, s, most).select("doc", "hop", "via").collect()) == walk(seeds, links, most)
    assert graph.hops(e, s, 0).count() == 0


def test_scopes(spark):
    names = [f"{p}_doc" for p in "abcd"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    ask = lambda mode, ps: sorted(r[0] for r in search.permitted(df, "a", mode, ps).collect())
    assert ask("include", ["b"]) == ["a_doc", "b_doc"] and ask("exclude", ["c"]) == ["a_doc", "b_doc", "d_doc"] and ask("all", []) == names and ask("odd", []) == names
    assert ask("exclude", ["a"]) == names
    assert search.scope("p") == ["p_doc", "p_notes", "p_session"] and "p_visual" in search.scope("p", visual=True)
    with pytest.raises(ValueError):
        search.scope("p", "nowhere")


@pytest.mark.parametrize("name, ok", [("myproject_doc", True), ("loom_global_notes", True), ("system_config", False), ("", False), ("_doc", False), ("myproject", False)])
def test_collection_names(spark, name, ok):
    assert one(spark, F.lit(name).rlike(corpus.COLLECTION)) == ok


def test_many_queries_meet_by_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, [0.0] * 8), (201, [1.0]), (202, None)]
    p = spark.createDataFrame(rows, "id long, vector array<double>")
    q = p.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    few = sorted(tuple(r) for r in search.nearest(p, q, 3).select("query_id", "id", "rank").collect())
    pairs = sorted((r["a"], r["b"]) for r in search.near_duplicates(p, 0.5).collect())
    cos = lambda x, y: sum(map(float.__mul__, x, y)) / (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    assert pairs == [(i, j) for i, x in rows[:120] for j, y in rows[:120] if i < j and cos(x, y) > 0.5]
    for i, x in rows[:120]:
        best = sorted((-cos(x, y), j) for j, y in rows[:120] if j != i)[:3]
        assert sorted((i, j, n) for n, (_, j) in enumerate(best, 1)) == [r for r in few if r[0] == i]
    for name in ("POINT_ROWS", "QUERY_ROWS", "AT_ONCE"):
        monkeypatch.setattr(search, name, 30)
    assert sorted(tuple(r) for r in search.nearest(p, q, 3).select("query_id", "id", "rank").collect()) == few
    assert sorted((r["a"], r["b"]) for r in search.near_duplicates(p, 0.5).collect()) == pairs


def test_hops_look_for_the_edges_of_hits_only(spark, sf, monkeypatch):
    from corpusloom import plans

    asked, nearest = [], search.nearest
    monkeypatch.setattr(search, "nearest", lambda points, queries, *a, **b: asked.append(queries.count()) or nearest(points, queries, *a, **b))
    plans.queries()["search_with_hops"](spark, sf).collect()
    assert asked[0] == 10 and asked[1] <= 30  # of 500 vectors


def test_leading_rows_equal_sorting(monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 7)
    rnd = np.random.default_rng(5)
    for m, k in ((1, 3), (5, 3), (700, 4), (3000, 4)):
        x = rnd.normal(size=(m, 16))
        x[m // 2 :] = x[: m - m // 2] + rnd.choice([0.0, 1e-9, 1e-7], size=(m - m // 2, 1))  # closer than single precision tells
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = rnd.permutation(m) % max(1, m - 3)  # some twice
        q, own = x[:40], ids[:40]
        cos = (q[:, None, :] * x[None, :, :]).sum(axis=2)
        for least in (-np.inf, 0.5):
            r, c, score = search._leading(q, x, ids, search._same(ids, own), k, least)
            for i in range(len(q)):
                mine = score[r == i]
                want = np.sort(cos[i][(ids != own[i]) & (cos[i] >= least)])[::-1][:k]
                assert np.allclose(mine, want, rtol=0, atol=1e-15) and not (ids[c[r == i]] == own[i]).any()


def test_equal_vectors_tie_by_id(spark):
    v = [math.sin(i + 1) for i in range(65)]
    p = spark.createDataFrame([(i, v) for i in range(300)], "id long, vector array<double>")
    got = search.nearest(p, p.filter("id < 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 4)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got.collect()) == [(q, n, i) for q in range(3) for n, i in enumerate([i for i in range(5) if i != q][:4], 1)]


def test_recall(spark):
    points = [(1, [1.0, 0.0], "a_doc", "docs/x.md", "x", "one"), (2, [0.7, 0.7], "b_doc", "", "y", "two"), (3, [0.0, 1.0], "a_notes", None, "z", "three")]
    p = spark.createDataFrame(points, "id long, vector array<double>, collection string, file_path string, slug string, text string")
    prompts = spark.createDataFrame([(11, "sure", [1.0, 0.0]), (12, "yes", [0.9, 0.6]), (13, "no", [0.9, 0.6]), (14, "late", [0.9, 0.6]), (15, "broken", [0.9, 0.6]), (16, "far", [-1.0, -1.0])], "query_id long, prompt string, query array<double>")

    def judge(prompt, excerpts):
        if prompt == "late":
            raise TimeoutError
        return {"yes": True, "no": False}[prompt]

    got = {r["query_id"]: r["block"] for r in search.recall(p, prompts, judge, current="a", mode="include", k=2).collect()}
    assert set(got) == {11, 12, 14} and "docs/x.md (1.00): one" in got[11] and "two" not in got[12]


def test_extractions_are_cut_by_their_kind():
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    text = f"intro\n\n{table}\n\noutro"
    by_table, plain = [("text", "intro"), ("table", table), ("text", "outro")], [("text", text)]
    for content, tables, want in (("text", False, by_table), ("mixed", False, by_table), ("image", True, by_table), ("image", False, plain), ("table", False, plain)):
        assert chunking.chunk_extraction(text, content=content, tables=tables) == want
    assert chunking.chunk_extraction(" ") == []


def greedy(paragraphs, most, overlap):
    """Paragraph by paragraph."""
    out, now = [], []

    def fits(p):
        return sum(map(chunking.tokens, now)) + chunking.tokens(p) <= most

    for p in paragraphs:
        if now and not fits(p):
            out.append("\n\n".join(now))
            lead = chunking.tail_words(out[-1], overlap) if overlap > 0 else ""
            now = [f"{lead} {p}"] if lead else [p]
            heads = [lead, p] if lead else [p]
            out.append(heads)  # how it begins
        else:
            now.append(p)
    return out, now


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=30).map(" ".join), max_size=9), st.integers(3, 60), st.integers(0, 20))
def test_plain_chunks_are_greedy(paragraphs, most, overlap):
    got = chunking.chunk_plain("\n\n".join(paragraphs), most, overlap)
    done, rest = greedy(paragraphs, most, overlap)
    assert len(got) == sum(isinstance(x, str) for x in done) + bool(rest)
    # each chunk: a lead of the one before, then whole paragraphs, all of them once
    at = 0
    for i, chunk in enumerate(got):
        parts = chunk.split("\n\n")
        lead = chunking.tail_words(got[i - 1], overlap) if i and overlap > 0 else ""
        parts = parts[len(lead.split("\n\n")) :] if lead else parts
        assert parts == paragraphs[at : at + len(parts)] and parts
        at += len(parts)
    assert at == len(paragraphs)


def test_repository_end_to_end(spark, tmp_path):
    def put(name, body):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)

    put("docs/a/A.md", "---\nrelated: [docs/b/B.md, docs/gone.md]\nlast_reviewed: 2026-01-01\nid: 1\n---\n# A\nbody\n## One\ntext\n### Two\nmore\n")
    put("docs/b/B.md", "---\nstatus: prototype\n---\nbody")
    put("docs/c/C.md", "no frontmatter")
    put("stray.md", "x")
    put("README.md", "x")
    put(".loom/sidecars/docs/a/A.embed-meta.yaml", "sidecar_id: s1\ncurrent_path: docs/a/A.md\nstatus: embedded\nfile_mtime: 1.0\nchunk_count: 3\nfile_hash: zzz\n")
    put(".loom/sidecars/docs/x.embed-meta.yaml", "sidecar_id: s2\ncurrent_path: docs/x.pdf\n")
    put(".loom/sidecars/docs/bad.embed-meta.yaml", "a: [")
    root = str(tmp_path)
    md = corpus.markdown(spark, root)
    docs = md.withColumn("frontmatter", corpus.frontmatter(F.col("text")))
    files, sidecars = corpus.files(spark, root).withColumn("hash", ids.file_hash(F.col("content"), F.col("path"))), corpus.sidecars(spark, root)
    commits = spark.createDataFrame([("docs/b/B.md", "2026-02-01")], "path string, d string").select("path", F.to_date("d").alias("last_commit"))
    found = {(r["type"], r["doc"]) for r in checks.scan(docs, files, sidecars, commits, F.lit("2026-03-01").cast("date")).collect()}
    assert found == {
        ("homeless_doc", "stray.md"), ("missing_frontmatter", "docs/c/C.md"), ("prototype_doc", "docs/b/B.md"), ("stale_last_reviewed", "docs/a/A.md"), ("broken_related", "docs/a/A.md"),
        ("one_way_link", "docs/a/A.md"), ("stale_related", "docs/a/A.md"), ("orphaned_doc", "docs/a/A.md"), ("orphaned_doc", "docs/c/C.md"),
        ("sidecar_parse_error", ".loom/sidecars/docs/bad.embed-meta.yaml"), ("sidecar_path_drift", ".loom/sidecars/docs/x.embed-meta.yaml"), ("embed_drift", "docs/a/A.md"),
    }
    cut = [(r["page"], r["heading"]) for r in corpus.sections(md.filter("path = 'docs/a/A.md'")).orderBy("page").collect()]
    assert cut == [(1, "# A"), (2, "## One"), (3, "### Two")]
    reg = corpus.registry(sidecars, files)
    points = spark.createDataFrame([("p0", "s1", 0, "t", "spec", "docs/a/A.md"), ("p1", "s9", 0, "u", "spec", None), ("p2", "", 0, "u", "spec", None)], "point_id string, sidecar_id string, chunk_index int, text string, doc_type string, file_path string")
    got = {(r["category"], r["id"]) for r in audit.audit(files, sidecars.filter("NOT failed"), reg, corpus.chunk_index(points), F.current_timestamp()).collect()}
    assert got == {
        ("orphaned_chunks", "orphaned_s9"), ("missing_sidecars", "missing_sidecar_s9"), ("stale_sidecars", "stale_s1"), ("hash_mismatches", "hash_mismatch_s1"), ("disconnected_files", "disconnected_B"),
        ("disconnected_files", "disconnected_C"), ("qdrant_sidecar_mismatches", "mismatch_s1"), ("missing_source_sidecars", "missing_source_x"),
    }


def test_config():
    assert corpus.merged_config({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    with pytest.raises(ValueError):
        corpus.checked_config({"project_name": " "})
    assert corpus.find_upwards(PurePosixPath("/a/b/c"), lambda p: str(p) == "/a/.loom/config.yaml") == PurePosixPath("/a/.loom/config.yaml")


def test_reading_pages_and_routing(spark):
    found = spark.createDataFrame([("a.pdf", bytearray(b"Title|body"))], "path string, content binary")
    got = corpus.pages(found, lambda c: [[(s, 14.0 if i == 0 else 10.0) for i, s in enumerate(c.decode().split("|"))]]).first()
    assert (got["text"], got["headings"]) == ("Title\nbody", ["Title"])
    rows = [(1, 1, "pure_text", b""), (1, 2, "structured_text", b"o"), (1, 3, "flattened", b"o"), (1, 4, "text_with_images", b"v")]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "doc_id int, page int, page_class string, image binary")
    got = sorted((r["page"], r["model"], r["text"]) for r in pages.routed(df, lambda b: "ocr", lambda b: "seen").collect())
    assert got == [(2, "ocr", "ocr"), (3, "vision", "seen"), (4, "vision", "seen")]


def test_state(spark):
    state = spark.createDataFrame([("a", 1.0, "h", 2), ("b", 1.0, "h", 2), ("c", 1.0, "h", 2)], "path string, file_mtime double, file_hash string, generation int")
    now = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "h"), ("c", 2.0, "x"), ("d", 1.0, "x")], "path string, mtime double, hash string")
    got = {r["path"]: (r["action"], r["generation"]) for r in lifecycle.detect_changes(state, now).collect()}
    assert got == {"a": ("skip_mtime", 2), "b": ("skip_hash", 2), "c": ("reembed", 3), "d": ("new", 1)}
    h = F.array(*[F.struct(F.lit(x).alias("hash"), F.lit(i).alias("generation"), F.lit("t").alias("indexed_at")) for i, x in enumerate("ab")])
    assert [v["hash"] for v in one(spark, lifecycle.with_version(h, F.lit("c"), F.lit(3), F.lit("t")))] == ["b", "c"]


def test_sidecar_upkeep(spark):
    files = spark.createDataFrame([("docs/a.pdf",), ("docs/a.md",), ("docs/manuals/n.md",)], "path string")
    side = spark.createDataFrame([(".loom/sidecars/docs/a.embed-meta.yaml", None), ("docs/b.embed-meta.yaml", "docs/b.md")], "sidecar_path string, current_path string")
    assert {r["current_path"] for r in lifecycle.heal(side, files).collect()} == {"docs/a.pdf", "docs/b.md"}
    assert {r["sidecar_path"] for r in lifecycle.migrate(side).collect()} == {".loom/sidecars/docs/a.embed-meta.yaml", ".loom/sidecars/docs/b.embed-meta.yaml"}
    new = lifecycle.induct(files, side, "p").orderBy("current_path").collect()
    assert [(r["slug"], r["doc_type"], r["file_type"]) for r in new] == [("a", "unknown", "markdown"), ("a", "unknown", "pdf"), ("n", "manual", "markdown")]
    assert lifecycle.orphaned(side, files).count() == 1


@pytest.mark.parametrize("every", [32, 2])
def test_stream_follows_snapshots(spark, tmp_path, monkeypatch, every):
    monkeypatch.setattr(changes, "EVERY", every)
    snaps, state, actions = (str(tmp_path / x) for x in ("snaps", "state", "actions"))
    steps = [[("a", 1.0, "x"), ("b", 1.0, "y")], [("a", 2.0, "z"), ("b", 2.0, "y")], [("c", 1.0, "u"), ("a", 2.0, "z")], [("b", 3.0, "v")], [("a", 3.0, "w"), ("a", 4.0, "t")], [("d", 1.0, "x")]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, "path string, mtime double, hash string").coalesce(1).write.parquet(f"{snaps}/{i}")
        stream = spark.readStream.schema("path string, mtime double, hash string").parquet(f"{snaps}/*")
        changes.follow(stream, state, actions, str(tmp_path / "check")).awaitTermination(120)
    want = {"a": (4.0, "t", 3), "b": (3.0, "v", 2), "c": (1.0, "u", 1), "d": (1.0, "x", 1)}
    found = lambda: {r["path"]: (r["file_mtime"], r["file_hash"], r["generation"]) for r in changes.newest(spark, state).collect()}
    assert found() == want
    done = lambda n: {(r["path"], r["action"]) for r in spark.read.parquet(f"{actions}/n{n}").collect()}
    assert done(1) == {("a", "reembed"), ("b", "skip_hash")} and done(2) == {("c", "new"), ("a", "skip_mtime")}
    for n in (4, 5):  # run again after a failure
        changes.apply(spark.createDataFrame(steps[n], "path string, mtime double, hash string"), n, state, actions)
    assert found() == want and done(4) == {("a", "reembed")} and done(5) == {("d", "new")}
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "state").glob("whole=*/batch=*"))
    assert kept == ([3, 4, 5] if every == 2 else [0, 1, 2, 3, 4, 5])


def test_models(spark):
    asked = []

    def short(most):
        def embed(text):
            asked.append(text)
            if len(text.split()) > most:
                raise models.TooLong
            return [len(text.split())]

        return embed

    words = " ".join(f"w{i}" for i in range(40))
    assert models.embed_one(short(23), words) == [23] and [len(t.split()) - 1 for t in asked] == [40, 30, 22]
    assert all(t.startswith("search_document: w0 w1") for t in asked)
    for most, tried in ((5, 4), (16, 4)):
        asked.clear()
        with pytest.raises(models.TooLong):
            models.embed_one(short(most), words)
        assert len(asked) == tried
    asked.clear()
    with pytest.raises(models.TooLong):
        models.embed_one(short(3), "only twelve words are in this text and so it has one more")
    assert len(asked) == 1
    seen = []

    def slow(cancelled):
        cancelled.wait(10)
        seen.append(cancelled.is_set())

    with pytest.raises(models.Late):
        models.within(0.05, slow)
    assert models.within(5, lambda _: 3) == 3
    with pytest.raises(KeyError):
        models.within(5, lambda _: {}["x"])

    def load():
        import time

        def embed(text):
            if "slow" in text:
                time.sleep(5)
            if "bad" in text:
                raise OSError("no")
            return [1.0]

        return embed

    df = spark.createDataFrame([("a", 0, "fine"), ("a", 1, "bad"), ("a", 2, None), ("b", 0, "slow"), ("b", 1, "fine too")], "slug string, chunk_index int, text string").coalesce(1)
    got = {(r["slug"], r["chunk_index"]): (r["vector"], (r["error"] or "").split(":")[0]) for r in models.embedded(df, load, seconds=1.0).collect()}
    assert got == {("a", 0): ([1.0], ""), ("a", 1): (None, "OSError"), ("a", 2): (None, "ValueError"), ("b", 0): (None, "Late"), ("b", 1): ([1.0], "")}
    assert seen == [True] or not seen


def test_page_vectors(spark):
    def load():
        def embed(images):
            if b"bad" in images:
                raise OSError
            return [[[float(len(i)), 1.0]] * 2 for i in images]

        return embed

    def absent():
        raise ImportError

    df = spark.createDataFrame([("a", i, bytearray(b"bad" if i == 5 else b"x" * i)) for i in range(1, 7)] + [("a", 9, None)], "slug string, page_num int, png binary").coalesce(1)
    got = {r["page_num"]: r["vectors"] for r in models.page_vectors(df, load, 2).collect()}
    assert got == {i: [[i, 1.0]] * 2 for i in range(1, 5)}
    assert models.page_vectors(df, absent).count() == 0


def test_store(spark, tmp_path):
    folder = str(tmp_path / "c")
    made = store.create_if_missing(spark, folder, "p_visual", "visual", "slug string")
    assert made.count() == 0 and made.schema["vectors"].metadata["size"] == 128
    spark.createDataFrame([("1", [[1.0]], "s")], made.schema).write.mode("append").parquet(f"{folder}/p_visual")
    assert store.create_if_missing(spark, folder, "p_visual", "visual", "slug string").count() == 1
    pages_ = spark.createDataFrame([("cache/x/page_0001.png", bytearray(b"1")), ("cache/y/page_0002.png", bytearray(b"2")), (None, bytearray(b"3"))], "path string, png binary")
    assert store.write_page_files(pages_, str(tmp_path)).count() == 2
    assert (tmp_path / "cache/y/page_0002.png").read_bytes() == b"2" and len(list(tmp_path.glob("cache/*/*"))) == 2


def test_single_writer(tmp_path):
    import os
    import socket
    import subprocess

    lock = tmp_path / "lock"
    with store.single_writer(str(lock)):
        assert lock.read_text() == f"{socket.gethostname()} {os.getpid()}"
        with pytest.raises(store.Busy):
            with store.single_writer(str(lock)):
                pass
    assert not lock.exists()
    gone = subprocess.Popen(["true"])
    gone.wait()
    for left in (f"{socket.gethostname()} {gone.pid}", "", "nonsense", f"{socket.gethostname()} -1"):
        lock.write_text(left)
        with store.single_writer(str(lock)):
            pass
    lock.write_text("elsewhere 1")
    with pytest.raises(store.Busy):
        with store.single_writer(str(lock)):
            pass


def test_chunks_leave_in_steps(spark):
    """A worker's memory does not go with all that a batch of texts makes."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) >> 8  # MB
    texts = spark.createDataFrame([(i, "x" if i % 10 else None) for i in range(220)], "doc_id long, text string").coalesce(1)
    got = chunking.by_document(texts, lambda t: [(held(), t * 2_000_000)], "held int, chunk string").select("doc_id", "held", F.length("chunk").alias("n")).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in range(220) if i % 10] and {r["n"] for r in got} == {2_000_000}
    assert max(r["held"] for r in got) - min(r["held"] for r in got) < 150


def test_steps_lose_no_rows(spark, monkeypatch):
    monkeypatch.setattr(chunking, "STEP", 200)
    words = [("k%d" % i, " ".join(f"w{j}" for j in range(i * 7))) for i in range(40)] + [(None, "a b"), ("empty", ""), ("null", None)]
    fold = lambda t: [(n, w, None) for n, w in enumerate(t.split())]
    df = spark.createDataFrame(words, "key string, text string")
    for given in (df, df.filter("false")):
        got = chunking.by_document(given, fold, "n int, word string, none string", key="key")
        want = [(k, n, w, None) for k, t in words if t for n, w in enumerate(t.split())] if given is df else []
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_audit_deals_by_rows(spark, sf, monkeypatch):
    """Parts go by rows, however few bytes they have, and the detectors find the same."""
    from corpusloom.plans import queries, state_queries
    from corpusloom.plans.registry import Tables

    t, want = Tables(spark, sf), sorted(map(tuple, queries()["audit_by_category"](spark, sf).collect()))
    monkeypatch.setattr(corpus, "POINT_ROWS", 500)
    monkeypatch.setattr(corpus, "FILE_ROWS", 100)
    assert audit.hash_mismatches(state_queries.registry(t), state_queries.files(t)).rdd.getNumPartitions() >= 14
    assert state_queries.index(t).rdd.getNumPartitions() >= 11
    assert sorted(map(tuple, queries()["audit_by_category"](spark, sf).collect())) == want
