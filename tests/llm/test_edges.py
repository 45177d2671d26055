"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns and hot keys, for each operator and stage."""

import os
import random
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm import ODD, brute_lines, line_rows, near_rows, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from nxtide.llm import chat, common, components, decontaminate, html_text, line_dedup, neighbours, queries, sentencepieces, sharding, simhash, token_counts, toxicity  # noqa: E402

#: Names that operators use themselves.
CLASHES = "severity toxic p_toxic expected_severity ids n_tokens decoded kept_text n_lines n_dropped shard slot fp similarity _doc _text _text_id _dropped _lines _host _paths _graded _part _rank _rows _salt".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, x long").drop("x").withColumn("n_chars", F.length("text"))
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).select("doc_id", "text", "lang", "n_chars", *CLASHES)


def path():
    return queries.tokenizer_path("piece_bpe_32k.model")


def test_clashing_columns(spark, clashing):
    n, bench = len(ODD), spark.createDataFrame([(1, "the same text twice over here")], "item_id long, text string")
    replaced = {
        "toxicity": (toxicity.score(clashing, toxicity.Severity({"same": 1.0}, [1.0, 2.0, 3.0])), {"severity", "toxic", "p_toxic", "expected_severity"}),
        "pieces": (sentencepieces.encode(clashing, path()), {"ids", "n_tokens", "decoded"}),
        "lines": (line_dedup.LineIndex.empty(spark, shards=4).insert(clashing).clean(clashing), {"kept_text", "n_lines", "n_dropped"}),
        "shards": (sharding.shuffle_to_shards(clashing, ["doc_id", "text"], 3), {"shard", "slot"}),
    }
    for name, (out, new) in replaced.items():
        assert len(out.columns) == len(set(out.columns)) and out.count() == n, name
        row = out.first()
        assert all(row[c] == f"own {c}" for c in CLASHES if c not in new), name
        assert not any(row[c] == f"own {c}" for c in new), name
    assert simhash.fingerprint_components(clashing).count() == n
    assert simhash.keep_one(clashing, simhash.near_duplicates(clashing)).columns == clashing.columns
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(clashing, bench).collect()} == {(5, 1)}
    assert token_counts.count_tokens(clashing, queries.tokenizer_path("word_bpe_49k.json")).count() == n
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.lit("http://h.com").alias("url"), F.col("text").alias("html"), "text", "_host", "_paths")
    out = html_text.main_texts(pages)
    assert out.count() == n and out.first()["_host"] == "own _host" and len(out.columns) == 6
    vectors = spark.createDataFrame([(i, [float(i), 1.0], "x", "y") for i in range(5)], "vec_id long, embedding array<double>, leaf string, v string")
    index = neighbours.NearestIndex.build(vectors)
    assert index.search(index.vectors.select("vec_id", "v")).count() == 20
    turns = spark.createDataFrame([(1, 0, "user", "a", "x")], "conv_id long, turn int, role string, text string, n_turns string")
    assert chat.format_chats(turns, queries.tokenizer_path("byte_bpe_50k.json")).first()["n_turns"] == 1


def test_empty_tables(spark, clashing):
    none = clashing.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert simhash.fingerprint_components(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_texts(pages).count() == 0 and html_text.main_texts(pages, send_bytes=-1).count() == 0
    assert line_dedup.LineIndex.empty(spark).clean(clashing).filter("n_dropped > 0").count() == 0
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_on_odd_rows(spark, tiny, clashing):
    twins = clashing.unionByName(clashing.filter("doc_id = 6").withColumn("text", F.lit("another text that has the same id")))
    docs = corpus_pipeline.without_toxic(spark, twins, tiny)
    assert docs.columns == twins.columns and sorted(map(str, docs.collect())) == sorted(map(str, twins.collect()))
    lines = corpus_pipeline.without_repeated_lines(spark, docs, tiny)
    assert lines.columns == docs.columns and lines.count() == len(ODD) + 1 and lines.filter("n_lines <> 'own n_lines' or n_chars <> length(text)").count() == 0
    single = corpus_pipeline.without_near_duplicates(spark, lines, tiny)
    # texts without words are alike, repeated rows are one, texts that share an id are not
    assert sorted(str(r["doc_id"]) for r in single.collect()) == ["1", "5", "6", "6", "7", "None"] and single.columns == docs.columns
    clean = corpus_pipeline.without_benchmark(spark, single, tiny)
    assert clean.count() == 6 and clean.columns == docs.columns
    assert corpus_pipeline.as_pieces(spark, clean, tiny).count() == 6
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.limit(0), tiny).count() == 0


def test_benchmark_stage_tells_texts_apart(spark, tiny):
    item = spark.read.parquet(f"{tiny}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, item), (None, "a clean text without an id"), (3, item), (3, "a clean text with it")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.without_benchmark(spark, docs, tiny).collect()) == ["a clean text with it", "a clean text without an id"]


def test_hot_keys_change_nothing(spark, monkeypatch):
    rows = near_rows()
    near = spark.createDataFrame(rows, "doc_id long, text string")
    own = line_rows(1, 60)
    lines = spark.createDataFrame(own, "doc_id long, text string")
    want = sorted(map(str, simhash.near_duplicates(near).collect()))
    prints = sorted(map(str, simhash.fingerprint_components(near).collect()))
    for module in (common, simhash, components):
        monkeypatch.setattr(module, "SPREAD_ROWS", 2)
    assert sorted(map(str, simhash.near_duplicates(near).collect())) == want
    assert sorted(map(str, simhash.fingerprint_components(near).collect())) == prints
    index = line_dedup.LineIndex.empty(spark, shards=4).insert(lines)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["kept_text"]) for r in index.clean(lines).collect()) == brute_lines(own)
    table = queries.tokenizer_path("word_bpe_49k.json")
    want = sorted(map(str, token_counts.count_tokens(near, table, hot=0).collect()))
    monkeypatch.setattr(common, "SPREAD_ROWS", 10**6)
    assert sorted(map(str, token_counts.count_tokens(near, table, hot=0).collect())) == want
    edges = spark.createDataFrame([(0, i) for i in range(1, 50)] + [(60, 61)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.connected_components(edges).collect()} == {**dict.fromkeys(range(50), 0), 60: 60, 61: 60}


def test_recall_of_pairs_that_are_just_similar(spark):
    rng, rows = random.Random(21), []
    for i in range(400):
        body = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 250))]
        other = list(body)
        while simhash.similar(" ".join(body), " ".join(other), 5) > 0.85:
            other[rng.randrange(len(other))] = "changed"
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(other))]
    pairs = [(rows[2 * i], rows[2 * i + 1]) for i in range(400)]
    alike = {a[0] for a, b in pairs if simhash.similar(a[1], b[1], 5) >= 0.8}
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) > 200 and sum(got[d + 1] == d for d in alike) >= 0.97 * len(alike)
    assert all(got[d + 1] == d + 1 for d in range(0, 800, 2) if d not in alike)


def test_severity_follows_planted_grades(spark):
    rng, rows, labels, grade = random.Random(8), [], [], {}
    plain, bad = [f"word{i}" for i in range(400)], [f"vile{c}" for c in "abcdefghijklmnopqrst"]
    for d in range(1600):
        g = d % 4
        rows.append((d, " ".join(rng.choices(plain, k=60) + rng.sample(bad, [0, 3, 8, 15][g]))))
        grade[d] = g
        labels.append((d, int(g > 0), g))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, g int").filter("doc_id < 1200")
    for column, least in (("toxic", 0.9), ("g", 0.95)):
        model = toxicity.fit(docs, labels.select("doc_id", F.col(column).alias("toxic")))
        out = toxicity.score(docs.filter("doc_id >= 1200"), model).select("doc_id", "expected_severity", "severity").collect()
        means = [np.mean([r["expected_severity"] for r in out if grade[r["doc_id"]] == g]) for g in range(4)]
        assert means == sorted(means) and means[1] > 0.5
        assert np.mean([r["severity"] == grade[r["doc_id"]] for r in out]) >= least


def brute_nearest(x, ids, asked, k=20):
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    return {(ids[q], ids[j]) for q, row in zip(asked, np.argsort(-s, axis=1)[:, :k]) for j in row}


def test_neighbours_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    held = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in held]), np.array([v for _, v in held], float)
    rows = queries.op5_neighbours(spark, sf).collect()
    want = brute_nearest(x, ids, np.flatnonzero(ids % 20 == 0))
    assert len({(r["query_id"], r["vec_id"]) for r in rows} & want) >= 0.9 * len(want) and len(rows) == len(want)
    assert neighbours.NearestIndex.build(spark.read.parquet(f"{sf}/embeddings.parquet")).tree.leaves > 8
    assert all(0.9 <= r["calibrated_recall"] <= 1 for r in rows)


def test_neighbours_of_clusters_score_few(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 16))[rng.integers(80, size=6000)] + rng.normal(size=(6000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = neighbours.NearestIndex.build(df, sample=512)  # most of the tree grows beyond the sample
    assert index.tree.leaves > 32 and index.counts.max() <= 2 * 187
    rows = index.search(index.vectors.filter("vec_id % 20 = 0").select("vec_id", "v")).collect()
    want = brute_nearest(x, np.arange(6000), np.arange(0, 6000, 20))
    assert len({(r["query_id"], r["vec_id"]) for r in rows} & want) >= 0.9 * len(want)
    assert np.mean([r["scored"] for r in rows]) <= 6000 / 3


@pytest.mark.parametrize(
    "source, want",
    [
        ('<article class="post"><header class="entry-header"><h1>Title</h1></header><p>{a}</p></article>', "Title // {a}"),
        ('<article><h1 class="page-header">Title</h1><p>{a}</p></article>', "Title // {a}"),
        ('<article><h1>T</h1><div class="content side-by-side"><p>{a}</p></div></article>', "T // {a}"),
        ('<article><h1>T</h1><div class="form"><p>{a}</p></div></article>', "T // {a}"),
        ("<main><section class=one><p>{a}</p></section><section class=two><p>{b}</p></section></main>", "{a} // {b}"),
        ("<article><p>{a}</p></article><section id=comments><p>{b} {b}</p></section>", "{a}"),
        ("<article><p>{a}</p><div class=comment-list><p>{b} {b}</p></div><div class=ad>Buy</div></article>", "{a}"),
        ("<article><p>{a}</p><section class=related-work><p>{b}</p></section></article>", "{a} // {b}"),
        ("<div id=header><a href=/>x</a> Site</div><div id=content><h2>T</h2><div class=entry>{a}</div><div class=related-posts><a href=x>r</a></div></div>", "T // {a}"),
        ("<p>{a} x < y &lt;b&gt; &amp;c", "{a} x < y <b> &c"),
    ],
)
def test_pages_keep_their_articles(source, want):
    fill = lambda s: s.replace("{a}", words("a", 40)).replace("{b}", words("b", 30))
    assert html_text.Page(fill(f"<html><body>{source}</body></html>")).main_text().replace("\n\n", " // ") == fill(want)


@pytest.mark.parametrize("part", ['<a href="x ', "<div>", "<div class='a b'>x", "<", "<p>x", "<ul><li>", "<!-- ", "<nav>x", "</b></div>x", "<p a=b ", "<span hidden>x", "<td>x<table>"])
def test_malformed_pages_are_read_in_linear_time(part):
    began = time.time()
    html_text.Page(part * (1_000_000 // len(part))).main_text()
    assert time.time() - began < 15


def test_pages_and_paths_meet_by_a_shuffle(spark, tiny, monkeypatch):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url", "html")
    want = sorted(map(tuple, html_text.main_texts(pages).select("page_id", "text").collect()))
    monkeypatch.setattr(common, "SPREAD_ROWS", 2)
    assert sorted(map(tuple, html_text.main_texts(pages, send_bytes=-1).select("page_id", "text").collect())) == want


def test_pages_of_a_host_agree(spark):
    page = "<body><div class=x{i}><div class=story><p>{a}</p></div><div class=talk><p>{b}</p></div></div></body>"
    rows = [(i, f"http://h.com/{i}", page.format(i=i, a=words("a", 100), b=words("b", 10))) for i in range(9)]
    rows.append((9, "http://h.com/9", page.format(i=9, a=words("a", 30), b=words("b", 25))))  # alone it would take both
    assert html_text.Page(rows[-1][2]).main_text() == f"{words('a', 30)}\n\n{words('b', 25)}"
    out = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == words("a", 30) and out[0] == words("a", 100)


def test_tied_turns_are_ordered_by_their_text(spark):
    turns = [(1, 0, "user", "zeta"), (1, 0, "user", "alpha")]
    path = queries.tokenizer_path("byte_bpe_50k.json")
    made = [chat.read_back(chat.format_chats(spark.createDataFrame(t, "conv_id long, turn int, role string, text string"), path), path).first() for t in (turns, turns[::-1])]
    import hashlib

    assert made[0] == made[1] and made[0]["turns_sha256"] == hashlib.sha256(b"user\nalpha\nuser\nzeta\n").hexdigest()
