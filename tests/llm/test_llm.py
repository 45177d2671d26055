"""Each training-data operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
import os, sys; sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))  # noqa: E401, E702
from oracle import same
from pyspark.sql import functions as F

from nxtide.llm import chat, components, decontaminate, html_text, line_dedup, neighbours, queries, sentencepieces, sharding, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, fp long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
#: Null and empty texts, white space, a null id, repeated rows, a very long text, control strings.
ODD = [(1, None, "en", 1), (2, "", "en", 1), (3, " \t\n ", "en", 1), (None, "no id at all in this row", "en", 1), (5, "the same text twice over here", "en", 1), (5, "the same text twice over here", "en", 1), (6, LONG, "en", 1), (7, "<|endoftext|> </s> Σίσυφος ΣΑΣ é\n\x85x", None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1


def test_pieces_equal_the_other_library(spark, docs, odd):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, odd):
        want = sorted(own.encode([t or "" for _, t in texts(df)]))
        out = sentencepieces.encode(df, path)
        rows = out.collect()
        assert sorted(r["ids"] for r in rows) == want and all(r["n_tokens"] == len(r["ids"]) for r in rows)
        assert "lang" in out.columns and "text" not in out.columns
        back = sentencepieces.decode(out, path).collect()
        assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in texts(df)) and all(r["decoded"] for r in rows)
    assert sentencepieces.encode(docs.limit(0), path).count() == 0


def field(number, data):
    size = bytes([len(data) & 127 | 128, len(data) >> 7]) if isinstance(data, bytes) and len(data) > 127 else bytes([len(data)]) if isinstance(data, bytes) else b""
    return bytes([number << 3 | 2]) + size + data if isinstance(data, bytes) else bytes([number << 3, data])


def piece(text, score, kind=1):
    return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + field(3, kind))


def model(kind, pieces, bytes_too=True, squeeze=1):
    """The file of a model of that kind (1 unigram, 2 BPE), with control pieces and user-defined ones."""
    held = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + piece("<sep>", 0, 4) + piece("ab", 0, 4)
    held += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)) if bytes_too else b""
    return held + b"".join(piece(p, s) for p, s in pieces) + field(2, field(3, kind) + b"\x98\x02\x01") + field(3, field(3, 1) + field(4, squeeze) + field(5, 1))


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEF<>/0123456789x.,"
PIECES = {
    1: [(c, -9 - i / 50) for i, c in enumerate(dict.fromkeys(LETTERS))] + [("▁", -3), ("▁the", -4), ("quick", -6), ("▁quick", -5.5), ("qu", -7), ("foo", -6.5), ("▁foo", -6), ("oo", -7.5), ("th", -7.25), ("▁b", -5)],
    2: [("qu", -1), ("▁t", -2), ("he", -3), ("▁the", -4), ("qui", -5), ("ck", -6), ("quick", -7), ("▁quick", -8), ("fo", -9), ("foo", -10), ("▁foo", -11)] + [(c, -20 - i) for i, c in enumerate(dict.fromkeys("▁" + LETTERS))],
}
SAYINGS = ["quick<sep>foo", "the quick <sep> foo", "<s>quick</s><unk>", "  the  quick   ", "abc cab abab", "<sep>", "<sep><sep>the", "quick é 日本 <0x41> foo", "", " ", "the <se p> ab", "foo\nbar the", "xquickx▁the"]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_models_with_control_and_user_defined_pieces(tmp_path, kind, squeeze):
    import sentencepiece

    data = model(kind, PIECES[kind], squeeze=squeeze)
    own, rebuilt = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepieces.Loaded(data)
    rng = random.Random(kind)
    words = ["the", "quick", "foo", "ab", "<sep>", "<s>", " ", "  ", "é", "x", "boo", "."]
    texts = SAYINGS + ["".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(300)]
    assert [i.tolist() for i in rebuilt.encode(texts)] == [own.encode(t) for t in texts]
    path = tmp_path / "m.model"
    path.write_bytes(data)
    sentencepieces.verify(str(path))


def test_models_that_are_not_known(tmp_path):
    with pytest.raises(ValueError):
        sentencepieces.Loaded(model(2, PIECES[2]) + piece("zz", -30, 5))
    with pytest.raises(ValueError):
        sentencepieces.Loaded(model(1, PIECES[1]) + piece("a b", 0, 4))


def test_unigram_models_are_rebuilt():
    data = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{i:02X}>", -20, 6) for i in range(256)) + piece("▁a", -1) + piece("b", -2) + piece("▁ab", -2.5) + piece("▁", -3) + field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0) + field(5, 1))
    own = sentencepieces.Model(data)
    assert own.kind == sentencepieces.UNIGRAM
    assert [own.pieces[i][0] for i in next(sentencepieces.Loaded(data).encode(["ab b"]))] == ["▁ab", "▁", "b"]


# 2


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.xxhash64("doc_id", F.lit("held")) % 4 == 0
    model = toxicity.fit(docs, labels.filter(~held_out))
    rows = toxicity.score(docs, model).join(labels.filter(held_out).withColumnRenamed("toxic", "label"), "doc_id").collect()
    hits = sum(r["toxic"] for r in rows if r["label"] == 1), sum(r["label"] == 1 for r in rows)
    false = sum(r["toxic"] for r in rows if r["label"] == 0), sum(r["label"] == 0 for r in rows)
    assert hits[0] >= 0.85 * hits[1] and false[0] <= 0.015 * false[1]
    assert model.cuts == sorted(model.cuts) and all(0 <= r["expected_severity"] <= toxicity.GRADES - 1 for r in rows)


def test_cumulative_link_gradient_and_grades():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(600)]
    truth = np.linspace(-2, 2, 12)
    eta = np.array([truth[r].sum() for r in rows])
    grade = np.digitize(eta + rng.logistic(size=600), [0.0, 1.5, 3.0])
    w, cuts = toxicity._fit_cumulative(rows, grade, 12)
    assert np.corrcoef(w, truth)[0, 1] > 0.95 and cuts == sorted(cuts)
    p = toxicity.Severity({}, cuts).grades(eta)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == len(ODD)
    none = toxicity.fit(odd, labels.filter("toxic = 0"))
    assert toxicity.score(odd, none).filter("toxic").count() == 0


# 3


def test_chat_digests_equal_sql(spark, tiny):
    same(spark, tiny, queries.op3_chat_format, queries.OP3_SQL)


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "a<|end|>\\<|turn|>"), (1, 0, "user", None), (1, 2, "assistant", ""), (2, 0, None, "\\\\<\\|x"), (None, 0, "user", "q"), (3, 0, "assistant", LONG), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    chats = chat.format_chats(df, path)
    for r in chat.read_back(chats, path).collect():
        own = sorted([t for t in turns if t[0] == r["conv_id"]], key=lambda t: t[1])
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        learned = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for r in chats.collect():
        n = sum(t[0] == r["conv_id"] for t in turns)
        assert [sum(i == c for i in r["input_ids"]) for c in chat.CONTROLS.values()] == [n] * 3 and len(r["input_ids"]) == len(r["loss_mask"])
    assert chat.read_back(chat.format_chats(df.limit(0), path), path).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\<|end|>", "<|<|turn|>\n\\\\"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and chat.LEAD not in chat.escape(text)


# 4


def test_line_dedup_equals_sql(spark, tiny):
    same(spark, tiny, queries.op4_line_dedup, queries.OP4_SQL)


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return sorted((d if d is not None else -1, "\n".join(x for x in (t or "").split("\n") if d is None or gone.get(key(x), d) == d)) for d, t in rows)


def line_rows(seed, n):
    rng = random.Random(seed)
    lines = [f"line number {i} that is long enough" for i in range(12)] + ["short", "", "\tLINE number 3 that is long enough \r"]
    return [(i if i % 9 else None, "\n".join(rng.choices(lines, k=rng.randrange(6)))) for i in range(n)]


@pytest.mark.parametrize("send", [1 << 20, 0])
def test_lines_are_inserted_and_deleted(spark, send):
    rows = line_rows(1, 60)
    make = lambda rs: spark.createDataFrame(rs, "doc_id long, text string")
    a, b = rows[:40], rows[40:]
    index = line_dedup.LineIndex.empty(spark, shards=4, send_bytes=send).insert(make(a)).insert(make(b))
    cleaned = lambda ix, rs: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["kept_text"]) for r in ix.clean(make(rs)).collect())
    assert cleaned(index, rows) == brute_lines(rows)
    without = index.delete(make(b).select("doc_id"))
    assert cleaned(without, a) == brute_lines(a)
    assert sorted(map(tuple, without.refs.collect())) == sorted(map(tuple, line_dedup.LineIndex.empty(spark, shards=4).insert(make(a)).refs.collect()))
    assert cleaned(without.insert(make(b)), rows) == brute_lines(rows)


def test_changes_touch_few_shards(spark):
    make = lambda rs: spark.createDataFrame(rs, "doc_id long, text string")
    rows = [(i, f"line {i // 3} of the many that there are\nand line {i} that is in no other") for i in range(300)]
    index = line_dedup.LineIndex.empty(spark, shards=64).insert(make(rows))
    more = index.insert(make([(900, "line 7 of the many that there are\na line that is quite new here")]))
    for table in ("by_key", "counts"):
        assert len(getattr(more, table).versions[-1][1]) <= 2 and getattr(more, table).versions[0][:2] == getattr(index, table).versions[0][:2]
    touched = more.counts.versions[-1][1]
    read, all_ = index.counts.read(spark, touched).count(), index.counts.read(spark).count()
    assert all_ == 400 and read < 40
    less = more.delete(make([(900, None)]).select("doc_id"))
    assert len(less.counts.versions[-1][1]) <= 2
    assert sorted(map(tuple, less.refs.collect())) == sorted(map(tuple, index.refs.collect()))
    assert index.delete(make([(12345, None)]).select("doc_id")).refs.count() == 400
    assert {r["doc_id"]: r["n_dropped"] for r in more.clean(make(rows)).filter("n_dropped > 0").collect()} == {i: 1 for i in range(300) if i % 3 < 2 or i == 23}


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63, 3000)
    f = line_dedup.Cuckoo.sized(len(keys))
    assert f.add(keys) and f.holds(keys).all()
    others = rng.integers(-(2**63), 2**63, 20000)
    assert f.holds(others).mean() < 0.01
    f.remove(keys[:1500])
    assert f.holds(keys[1500:]).all() and f.holds(keys[:1500]).mean() < 0.01
    assert line_dedup.Cuckoo.read(f.write()).holds(keys[1500:]).all()
    assert not line_dedup.Cuckoo.sized(1).add(keys)


def test_lines_of_odd_rows(spark, odd):
    ix = line_dedup.LineIndex.empty(spark).insert(odd)
    out = ix.clean(odd)
    assert out.count() == len(ODD) and out.filter("n_dropped > 0").count() == 0 and out.filter("text is null").first()["n_lines"] == 1
    assert line_dedup.LineIndex.empty(spark).insert(odd.limit(0)).clean(odd.limit(0)).count() == 0


# 5


def test_neighbours_recall_and_order(spark, tiny):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = neighbours.NearestIndex.build(table, sample=128, probes=64, rows=20)
    assert index.tree.leaves > 8
    got = {}
    for r in index.search(index.vectors.filter("vec_id % 20 = 0").select("vec_id", "v")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    assert sorted(got) == [i for i in sorted(x) if i % 20 == 0]
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[v]) < 1e-12 for _, v, s in rows) and q not in [v for _, v, _ in rows]
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        best = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]
        hits += len({i for _, i in best} & {v for _, v, _ in rows})
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_are_all_there_for_skewed_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(10, 16)), 300, axis=0), np.repeat(rng.normal(size=(25, 16)), 5, axis=0)])
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + rng.normal(size=x.shape) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, x[3000].tolist())] * 30
    index = neighbours.NearestIndex.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index.visits = 1  # leaves of the small groups hold fewer than 20
    asked = index.vectors.filter("vec_id >= 3000 or vec_id % 300 = 0").select("vec_id", "v").dropDuplicates(["vec_id"])
    got = index.search(asked).groupBy("query_id").count().collect()
    assert sorted((r["query_id"], r["count"]) for r in got) == [(q, 20) for q in [*range(0, 3000, 300), *range(3000, 3125)]]


def test_neighbours_probes_are_not_fitted_to(spark, monkeypatch):
    fitted, fit = [], neighbours.Tree.fit.__func__
    monkeypatch.setattr(neighbours.Tree, "fit", classmethod(lambda cls, x, rows: fitted.append(len(x)) or fit(cls, x, rows)))
    for n, probes in ((100, 30), (20, 30), (1, 30)):
        neighbours.NearestIndex.build(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<double>"), probes=probes)
    assert fitted == [70, 10, 1]


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [1.0]), (None, [1.0, 1.0]), (105, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.NearestIndex.build(df)
    assert index.vectors.count() == 40
    out = index.search(index.vectors.filter("vec_id = 20").select("vec_id", "v")).orderBy("rank").collect()
    assert [r["vec_id"] for r in out][:3] == [0, 1, 2] and len(out) == 20
    few = neighbours.NearestIndex.build(df.filter("vec_id < 3"))
    assert few.search(few.vectors.select("vec_id", "v")).count() == 6
    none = neighbours.NearestIndex.build(df.limit(0))
    assert none.search(none.vectors.select("vec_id", "v")).count() == 0


# 6


def test_token_counts_equal_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for df in (docs, odd):
        want = sorted((-1 if d is None else d, len((t or "").encode()), n, n > 2048) for d, t in texts(df) for n in [len(own.encode(t or "", add_special_tokens=False).ids)])
        for hot in (0, 1000):
            rows = token_counts.count_tokens(df, path, hot=hot).collect()
            assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("text", ["It's DON'T we'll 'tis", "a1b22 ½ ²", "<|endoftext|><|ENDOFTEXT|>", "ΑΣ ΑΣ. İI", "é 한국 漢字…!!", "  x"])
def test_token_counts_of_texts(spark, text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_counts.count_tokens(df, path).first()["n_tokens"] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


# 7

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>x</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, a lot of them, on this page.</p></div><!-- <p>no</p> --><div class="ad">Buy</div><div class="c{n} main-col"><h1>Head {n}</h1><p>One &amp; two
  three<br>four <b>five</p><p>Six <a href=y>seven</a> eight words that are text.<ul><li>item</ul><form><input><p>Name</p></form></div><aside><p>Aside</p></aside><div id="comments"><p>A comment that is long enough to be read.</p></div><footer>&copy; F</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"https://www.h.com/{i}", PAGE.format(n=i)) for i in range(5)] + [(7, "http://h2.com", None), (8, None, "plain text &lt;only"), (9, "http://www.h.com", ""), (10, "nohost", "<p>" + LONG), (5, "https://www.h.com/5", "<body><div class='other'><p>Fallback text here</p></div>")]
    out = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert out[i] == f"Head {i}\n\nOne & two three four five\n\nSix seven eight words that are text.\n\nitem"
    assert (out[7], out[8], out[9], out[10], out[5]) == ("", "plain text <only", "", LONG, "Fallback text here")


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("tag", ["div class='layout has-sidebar'", "div class='site-content with-sidebar'", "div class='elementor-widget-container'", "div class='content no-comments'", "div class='page-wrapper nav-open'", "form id=aspnetForm"])
def test_page_within_a_wrapper_that_is_named_like_noise(tag):
    source = f"<body><h1>Title</h1><{tag}><nav><a href=x>{words('n', 20)}</a></nav><div class=text><p>{words('a', 80)}</p><p>{words('b', 80)}</p></div><div class=sidebar><p>{words('s', 9)}</p></div></{tag.split()[0]}><div class=footer>Foot</div></body>"
    assert html_text.Page(source).main_text(None) == f"{words('a', 80)}\n\n{words('b', 80)}"


def test_page_of_many_parts_that_are_named_like_noise():
    parts = [words(c, 50) for c in "abcd"]
    source = "<body><div class=all>" + "".join(f"<div class=widget><p>{p}</p></div>" for p in parts) + "</div></body>"
    assert html_text.Page(source).main_text("/body.x/div.all") == "\n\n".join(parts)


def test_long_comments_stay_out():
    source = f"<body><div class=post><p>{words('a', 40)}</p></div><div id=comments><p>{words('c', 150)}</p></div></body>"
    assert html_text.Page(source).main_text(None) == words("a", 40)


def test_noise_beside_a_short_article_stays_out():
    source = f"<body><article><p>{words('a', 15)}</p></article><div class=cookies><p>{words('c', 60)}</p></div><footer>{words('f', 60)}</footer></body>"
    assert html_text.Page(source).main_text("/body/article") == words("a", 15)


def test_page_keeps_heading_and_lead_of_its_article():
    source = f"<body><main><article><h1>Title</h1><div class=lead><p>{words('l', 20)}</p></div><div class=body><p>{words('b', 90)}</p></div></article><p>Other</p></main></body>"
    for path in (None, "/body/main/article/div.body"):
        assert html_text.Page(source).main_text(path) == f"Title\n\n{words('l', 20)}\n\n{words('b', 90)}"


def test_page_whose_text_is_elsewhere_than_its_host_s():
    source = f"<body><div class=content><p>Short</p></div><div class=story><p>{words('b', 90)}</p></div></body>"
    assert html_text.Page(source).main_text("/body/div.content") == words("b", 90)


def test_pages_of_the_table(spark, tiny):
    import html
    import re

    for r in queries.op7_html_text(spark, tiny).join(spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?!/?p>|/?h1>)[^>]*>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"].replace(" ", "") == "\n\n".join(p for p in parts if p).replace(" ", "") and r["n_chars"] == len(r["text"])


# 8


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(nodes)), 2):
        if linked(nodes[i], nodes[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def test_simhash_components(spark, tiny, docs):
    rows = sorted(texts(docs))
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = sorted((rows[i][0], f"{fps[i]:016x}", rows[r][0]) for i, r in enumerate(roots))
    assert sorted(tuple(r) for r in queries.op8_simhash(spark, tiny).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("radius, segments", [(4, 3), (7, 4), (11, 4)])
def test_no_pair_is_lost(spark, radius, segments):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "node long, fp long")
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= radius}
    assert {tuple(r) for r in simhash.pairs_within(df, radius, segments).collect()} == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    roots = brute_components(list(range(260 + 1)), lambda a, b: False)
    for _ in range(300):
        for a, b in edges:
            roots[a] = roots[b] = min(roots[a], roots[b])
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: roots[n] for e in edges for n in e if any(x != y for x, y in edges if n in (x, y))}


def near_rows(seed=5):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(800)]
    rows, k = [], 0
    for _ in range(8):
        text = rng.choices(words, k=300)
        for copy in range(5):
            changed = list(text)
            for _ in range(copy):
                changed[rng.randrange(300)] = "other"
            rows.append((k, ("  " if copy == 1 else " ").join(changed)))
            k += 1
    return rows + [(k, None), (k + 1, ""), (None, "x y z"), (None, "x y z"), (0, rows[0][1])]


def test_near_duplicates_leave_one_of_each_group(spark):
    rows = near_rows()
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in simhash.keep_one(df, simhash.near_duplicates(df)).collect())
    ids = [r for r in rows if r[0] is not None][:-1]
    roots = brute_components(ids, lambda a, b: simhash.similar(a[1], b[1], 5) >= 0.8)
    assert kept == sorted([-1, -1, *{ids[r][0] for r in roots}])
    none = df.limit(0)
    assert simhash.keep_one(none, simhash.near_duplicates(none)).count() == 0


def test_near_duplicates_with_other_repeats(spark):
    rng = random.Random(11)
    rows = []
    for i in range(6):
        body, line = (" ".join(f"{c}{i}x{rng.randrange(10**6)}" for _ in range(n)) for c, n in (("b", 300), ("l", 20)))
        rows += [(2 * i, f"{body} {line}"), (2 * i + 1, " ".join([body, *[line] * (10, 40)[i % 2]]))]
    assert all(simhash.similar(rows[2 * i][1], rows[2 * i + 1][1], 5) > 0.98 for i in range(6))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["group_id"]) for r in got) == [(k, k // 2 * 2) for k in range(12)]


@pytest.mark.parametrize("spread", [1000, 20])
def test_near_pairs_whatever_nodes_carry(spark, monkeypatch, spread):
    rng, plan = random.Random(5), simhash.Plan(1000, 0.8)
    monkeypatch.setattr(simhash, "SPREAD_ROWS", spread)
    base, rows = [rng.getrandbits(64) for _ in range(plan.whole)], []
    for node in range(120):  # of all degrees of likeness, within the radius and beyond
        share = rng.uniform(0.02, 0.2)
        rows.append((node, 100 + node % 3, node % 40, [w ^ sum((rng.random() < share) << b for b in range(64)) for w in base]))
    apart = lambda x, y: sum((v ^ w).bit_count() for v, w in zip(x, y))
    meet = lambda x, y: any(((x[w] ^ y[w]) >> o & (1 << plan.width) - 1).bit_count() <= 1 for w, o in plan.segments)
    pairs = [(p, t) for p in rows for t in rows if p[0] < t[0] and p[2] != t[2] and meet(p[3], t[3])]
    within = {(p[0], t[0]) for p, t in pairs if apart(p[3], t[3]) <= plan.radius}
    signed = [(n, s, r, [w - (1 << 64) * (w >> 63) for w in fp]) for n, s, r, fp in rows]
    nodes = spark.createDataFrame(signed, "node long, size int, root long, fp array<long>")
    got = {}
    for crowd in (0, 8, 10**6):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        found = simhash._near_pairs(nodes, plan, 0.8)
        got[crowd] = {(r["a"], r["b"]) for r in simhash._whole_distance(found, nodes, plan.radius).collect()}
        assert crowd or found.count() == len(got[0])
    assert 100 < len(got[0]) < len(pairs) and got[0] == within
    assert got[10**6] <= got[8] <= got[0] and len(got[10**6]) >= 0.99 * len(within)


def test_simhash_of_odd_rows(spark, odd):
    out = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.fingerprint_components(odd).collect()}
    assert out[(1, 0)] == out[(2, 0)] == out[(3, 0)] == 1
    assert simhash.fingerprint_components(odd).count() == len(ODD)


# 9


def test_shards(spark, docs, odd, tiny):
    rows = queries.op9_sharding(spark, tiny).collect()
    want = sorted((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts(docs))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(40)}
    assert all(v == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {len(rows) // 40, len(rows) // 40 + 1}
    assert sharding.shuffle_to_shards(odd.select("doc_id", "text"), ["doc_id", "text"], 3).count() == len(ODD)
    assert sharding.shuffle_to_shards(odd.select("doc_id").limit(0), ["doc_id"], 3).count() == 0


def test_shuffle_is_uniform(spark):
    rows = sharding.shuffle_to_shards(spark.range(4000).withColumnRenamed("id", "doc_id"), ["doc_id"], 8).collect()
    counts = np.zeros((8, 8))
    for r in rows:
        counts[r["doc_id"] // 500, r["shard"]] += 1
    assert counts.sum(axis=0).tolist() == [500] * 8 and ((counts - 62.5) ** 2 / 62.5).sum() < 100
    places = [r["slot"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert abs(np.corrcoef(np.arange(4000), places)[0, 1]) < 0.06


@pytest.mark.parametrize("counts", [[0, 0], [5, 0, 7], [10**11, 3, 10**11 + 1]])
def test_matrix(counts):
    m = sharding.communication_matrix(counts, 4, 1)
    assert m.sum(axis=1).tolist() == counts and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()


@pytest.mark.parametrize("good, bad, n", [(30, 50, 20), (5, 5, 5), (1000, 3, 500), (7, 9000, 600)])
def test_large_draws_have_the_exact_law(good, bad, n):
    from math import comb

    low, high = max(0, n - bad), min(n, good)
    law = np.array([comb(good, x) * comb(bad, n - x) / comb(good + bad, n) for x in range(low, high + 1)])
    rng = np.random.default_rng(3)
    seen = np.bincount([sharding._draw_large(rng, good, bad, n) - low for _ in range(4000)], minlength=len(law))
    often = law * 4000 > 5
    assert ((seen - law * 4000) ** 2 / (law * 4000))[often].sum() < often.sum() + 4.5 * (2 * often.sum()) ** 0.5
    assert all(abs(np.exp(sharding._log_chance(low + i, good, bad, n)) - p) <= 1e-12 + 1e-9 * p for i, p in enumerate(law))


def test_draws_of_very_many():
    rng, good, bad, n = np.random.default_rng(4), 10**12, 3 * 10**12, 5 * 10**11
    x = np.array([sharding._draw_large(rng, good, bad, n) for _ in range(500)], float)
    sd = (n * 0.25 * 0.75 * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert abs(x.mean() - n * 0.25) < 5 * sd / 500**0.5 and 0.85 < x.std() / sd < 1.15


def test_partitions_grow_with_the_rows(spark):
    rows = sharding.shuffle_to_shards(spark.range(3000).withColumnRenamed("id", "doc_id"), ["doc_id"], 3, rows_in_part=2).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(1000)) for k in range(3))


# 10


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        ws = (t or "").lower().split()
        for i, x in items:
            ys = (x or "").lower().split()
            if not ys or not ws:
                continue
            k = min(5, len(ys))
            bag = lambda w, k=k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            for s in range(max(1, len(ws) - len(ys) + 1)):
                a, b = bag(ws[s : s + len(ys)]), bag(ys)
                both, either = sum(min(a.count(g), b.count(g)) for g in {*a, *b}), sum(max(a.count(g), b.count(g)) for g in {*a, *b})
                if either and both / either >= 0.8:
                    out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 3, 5, 18, 40, 60, 25, 25])] + [(20, None), (21, " ")]
    docs = []
    for d in range(30):
        body = rng.choices(words, k=rng.randrange(120))
        item = items[d % 8][1].split()
        if d % 3 == 0:
            cut = rng.randrange(len(body) + 1)
            item = item[:-1] + ["new"] if d % 2 and len(item) > 20 else item
            body = body[:cut] + item + body[cut:]
        docs.append((d, "\t ".join(body).upper() if d % 5 == 0 else " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[4][1]), (102, items[4][1]), (None, items[5][1]), (103, " ".join(items[5][1].split()[:55]))]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for send in (decontaminate.BROADCAST_ROWS, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench, send_rows=send).collect()}
        assert got == brute_leaks(docs, items)
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_decontamination_of_the_table(spark, tiny, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    shingles = {tuple(w[j : j + 5]) for _, t in items for w in [t.lower().split()] for j in range(len(w) - 4)}
    maybe = [(d, t) for d, t in texts(docs) if any(tuple(w[j : j + 5]) in shingles for w in [t.lower().split()] for j in range(len(w) - 4))]
    assert {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, tiny).collect()} == brute_leaks(maybe, items)


# the pipeline


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        before, after = texts(docs), out.count()
        if name == "line_dedup":
            assert sorted((d, t) for d, t in texts(out)) == brute_lines(before)
            assert out.filter("n_chars <> length(text)").count() == 0
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            roots = brute_components(ids, lambda a, b: a[1] == b[1] or abs(len(a[1]) - len(b[1])) < 0.3 * max(len(a[1]), len(b[1]), 1) and simhash.similar(a[1], b[1], 5) >= 0.8)
            kept = {d for d, _ in texts(out)}
            assert {ids[i][0] for i, r in enumerate(roots) if i == r} <= kept and len(kept) <= 1.03 * len(set(roots))
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
            shingles = {tuple(w[j : j + 5]) for _, t in items for w in [t.lower().split()] for j in range(len(w) - 4)}
            maybe = [(d, t) for d, t in before if any(tuple(w[j : j + 5]) in shingles for w in [t.lower().split()] for j in range(len(w) - 4))]
            assert {d for d, _ in before} - {d for d, _ in texts(out)} == {d for d, _ in brute_leaks(maybe, items)}
        elif name == "sentencepiece":
            assert after == len(before) and out.filter("not decoded").count() == 0
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        docs = spark.createDataFrame(out.collect(), out.schema) if k < 4 else out
