"""op13: nodes against a plain trie, with weak fingerprints, small blocks, hot nodes and odd rows."""

import hashlib
import os
import random
import sys
import zlib
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same  # noqa: E402

from nxtide.llm import common, prefix_trie, queries  # noqa: E402

TURNS = "conv_id long, turn int, role string, text string"


def plain_rebuilt(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(head, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, cs in members.items():
        saved = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += saved
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children.get(p, 0), *below[p], ends(p)) for p, cs in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def trie(df, **how):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ranked(prefix_trie.hashed(df))), **how)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 9000), n):
        for turn in range(rng.choice([1, 1, 3, 5, 9, 14])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "hé", "yes", "no"])))
    rows += [(c, t, "user", "same") for c in range(20_000, 20_100) for t in range(12)]  # copies
    rows += [(30_000, t // 3, "user", f"t{t // 3}") for t in range(50)]  # ties and repeated rows
    rows += [(None, 1, "user", "no conversation"), (-7, 0, "user", "x" * 300_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"block_size": 3}), (3, {"moduli": (3, 2)}), (4, {"moduli": (2, 1), "block_size": 2})])
def test_nodes_equal_a_plain_trie(spark, seed, how):
    rows = rows_of(seed)
    assert found(trie(spark.createDataFrame(rows, TURNS), **how)) == plain_nodes(plain_rebuilt(rows))


def test_hot_nodes_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD_ROWS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 1)
    rows = rows_of(5)
    assert found(trie(spark.createDataFrame(rows, TURNS))) == plain_nodes(plain_rebuilt(rows))


def test_a_long_conversation_is_ranked_and_scanned_in_parts(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(9000)] + [(c, t, "user", f"t{t % 7}") for c in (1, 2, 10) for t in range(9)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    ranks = prefix_trie.ranked(prefix_trie.hashed(df))
    got = {(r["conv_id"], r["depth"]): bytes(r["sha"]) for r in ranks.collect()}
    assert got == {(c, t + 1): hashlib.sha256(f"4:user{x}".encode()).digest() for c, t, _, x in rows}
    out = trie(df, block_size=512)
    assert found(out) == plain_long(plain_rebuilt(rows))


def plain_long(convs):
    """As plain_nodes, where one conversation is far longer than all others: what is below its nodes is added from its end."""
    cut = {c: turns[:20] for c, turns in convs.items()}
    want = {(r[0], r[1]): r for r in plain_nodes(cut)}
    empty = hashlib.sha256().hexdigest()
    tail = len(convs[5])
    for d in range(20, tail + 1):
        want[(5, d)] = (5, d, 5, 1, int(d < tail), 1, 0, hashlib.sha256(b"5").hexdigest() if d == tail else empty)
    return sorted(want.values())


def test_query_equals_sql(spark, tiny):
    same(spark, tiny, queries.op13_prefix_trie, queries.OP13_SQL)


def test_empty_tables_and_turnless_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie(none).count() == 0 and trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0
    alone = [(c, 0, "user", "hi") for c in (6, 7, 8, 11)]  # no head, fewer turns than they give up
    rows = [r for r in alone if zlib.crc32(str(r[0]).encode()) % 9 > 0]
    assert found(trie(spark.createDataFrame(rows, TURNS))) == plain_nodes(plain_rebuilt(rows))


def test_extra_columns_are_of_no_account(spark):
    rows = rows_of(6, 10)
    df = spark.createDataFrame(rows, TURNS)
    more = df.selectExpr("*", "'x' AS depth", "'y' AS prefix", "'z' AS rep", "'v' AS tie", "'u' AS sha")
    assert found(trie(more)) == found(trie(df))
