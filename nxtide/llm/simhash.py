"""SimHash fingerprints, and near duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nxtide.llm.common import SPREAD_KEYS, SPREAD_ROWS, discard, free_names, join_spread, save, sided, text_of
from nxtide.llm.components import connected_components

#: Shingles whose bits are counted at a time, so that a long text needs no more memory than a short one.
CHUNK = 1 << 16
#: Nodes up to which tasks are sent which texts to compare (some 40 bytes each); beyond, texts are shuffled.
SENT = 500_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of each shingle of `width` words, repeats included; of the whole sequence where there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """Words of 64 bits, signed as Spark's long: a bit is 1 if set in over half the hashes, mixed anew for each further word; 0 without hashes."""
    if not len(hashes):
        return [0] * words
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.stack([hashes[i : i + CHUNK], *(_mixed(hashes[i : i + CHUNK], k) for k in range(1, words))], axis=1)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64).tolist()


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits of each hash: two rounds of multiplication by odd numbers and shifts."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fingerprint_of(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, width))[0] for t in texts], dtype="int64")

    return simhash(text_of(text))


def segments_of(bits: int, count: int) -> list[tuple[int, int]]:
    """(offset, width) of `count` segments of near equal width."""
    widths = [bits // count + (i < bits % count) for i in range(count)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def balls(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` of `width` bits."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def segment_value(fp: str, offset: int, width: int) -> str:
    return f"shiftrightunsigned({fp}, {offset}) & {(1 << width) - 1}L"


def index_keys(df: DataFrame, segments: int) -> DataFrame:
    """A row for each fingerprint `fp` and segment, with the segment's number and value as `key`."""
    keys = [f"({i}L << 40) | ({segment_value('fp', o, w)})" for i, (o, w) in enumerate(segments_of(64, segments))]
    return df.withColumn("key", F.explode(F.array(*map(F.expr, keys))))


def probe_keys(df: DataFrame, segments: int, radius: int) -> DataFrame:
    """A row for each key that a fingerprint within the radius may have in a segment.

    Of two segment values that differ, only that with a 0 in the lowest differing bit
    probes for the other one, so each pair meets once in a segment. Two fingerprints
    within the radius have a segment in which at most radius // segments bits differ.
    """
    parts = []
    for i, (o, w) in enumerate(segments_of(64, segments)):
        masks = ",".join(f"{m}L" for m in balls(w, radius // segments))
        value = segment_value("fp", o, w)
        parts.append(f"transform(filter(array({masks}), m -> (({value}) & m & (-m)) = 0), m -> ({i}L << 40) | (({value}) ^ m))")
    return df.withColumn("key", F.explode_outer(F.expr(f"concat({', '.join(parts)})")))


def pairs_within(nodes: DataFrame, radius: int, segments: int, where: str = "true") -> DataFrame:
    """Pairs (a, b) of nodes (node, fp, further columns) whose fingerprints differ in at most `radius` bits; distinct.

    where: a condition on p and t, the two nodes of a pair, for pairs that need not be made.
    The distance and the condition are part of the join, so what fails them is never a row.
    A probe for a segment's own value makes a pair in one order only.
    """
    p, t = probe_keys(nodes, segments, radius).alias("p"), index_keys(nodes, segments).alias("t")
    apart = " ".join(f"when {i}L then ({segment_value('(p.fp ^ t.fp)', o, w)}) <> 0" for i, (o, w) in enumerate(segments_of(64, segments)))
    near = F.expr(f"p.key = t.key and bit_count(p.fp ^ t.fp) <= {radius} and (p.node < t.node or case shiftright(p.key, 40) {apart} end) and ({where})")
    return p.join(t, near).select(F.least("p.node", "t.node").alias("a"), F.greatest("p.node", "t.node").alias("b")).distinct()


def fingerprint_components(docs: DataFrame, width: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id) for documents (doc_id, text), by links between fingerprints.

    Equal fingerprints are one node, however many documents have them, and the documents of one are
    dealt among copies of its component's row. A text without words (null, empty, or white space) has
    fingerprint 0, linked like any other. component_id is the smallest doc_id reachable; rows with a
    null doc_id are kept and take the smallest other one of their component, or null. Repeated rows
    stay; very long texts are hashed whole; an empty table stays empty; further columns are not read.
    At most (number of flips in a segment's ball) / 2 probes are made for a segment; with more
    documents take fewer, wider segments.
    """
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(F.col("text"), width).alias("fp")))
    prints = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(pairs_within(prints.select(F.col("fp").alias("node"), "fp"), radius, segments))
    linked = roots.join(prints, roots.node == prints.fp)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = prints.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left")
    by_print = save(by_print.select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    return join_spread(rows, by_print, ["fp"], "n", ["doc_id"]).select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def similar(a: str | None, b: str | None, width: int) -> float:
    """Jaccard similarity of the texts' shingles; 1 for two texts without words."""
    return _jaccard(*(np.unique(shingle_hashes(t, width)) for t in (a, b)))


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


#: Bits that a segment may have, the share of pairs of the least similarity that segments are to find, and the chance matches of a text that are too many.
WIDTHS, RECALL, MATCHES = (16, 21, 26, 32), 0.99, 4096
#: Words of a fingerprint at least: the more, the surer the distance of whole fingerprints tells pairs below the similarity apart.
WORDS = 16
#: Times the nodes that a segment's value has by chance (one at least) from which on it is crowded.
CROWD = 8


def distance(a: str, b: str) -> str:
    """Bits in which two fingerprints of several words differ."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)"


class Plan:
    """Segments for so many texts: as many as find pairs of a similarity with the chance RECALL, as wide as keeps chance matches few.

    Sets of similarity s have vectors at an angle whose cosine is 2s / (1 + s), if they are of one size, so each
    bit of their fingerprints differs with the chance angle / pi. A segment finds a pair if one bit of it differs at most.
    """

    def __init__(self, texts: int, similarity: float):
        apart = acos(2 * similarity / (1 + similarity)) / pi
        for self.width in WIDTHS:
            found = sum(comb(self.width, k) * apart**k * (1 - apart) ** (self.width - k) for k in (0, 1))
            self.words = max(2, ceil(ceil(log(1 - RECALL) / log(1 - found)) / (64 // self.width)))
            self.segments = [(w, i * self.width) for w in range(self.words) for i in range(64 // self.width)]
            if texts * len(self.segments) * (self.width + 1) / 2 ** (self.width + 1) <= MATCHES:
                break
        self.whole = max(WORDS, self.words)
        self.radius = int(self._bound(64 * self.whole, apart, 3.0))
        self.word_radius = int(self._bound(64, apart, 3.5))

    @staticmethod
    def _bound(bits: int, apart: float, deviations: float) -> float:
        """Bits in which hardly any pair of that similarity differs more."""
        return bits * apart + deviations * sqrt(bits * apart * (1 - apart))

    def keys(self, nodes: DataFrame, *more: str) -> DataFrame:
        """A row (node, size, root, key, other) for each segment: its number and value, and another word of the fingerprint; `more` columns follow."""
        mask = (1 << self.width) - 1
        parts = [f"named_struct('key', ({i}L << 40) | (shiftrightunsigned(fp[{w}], {o}) & {mask}L), 'other', fp[{(w + 1) % self.whole}])" for i, (w, o) in enumerate(self.segments)]
        return nodes.select("node", "size", "root", *more, F.explode(F.expr(f"array({', '.join(parts)})")).alias("k")).select("node", "size", "root", "k.key", "k.other", *more)

    def probes(self, keys: DataFrame) -> DataFrame:
        """keys, and those with one bit of the value flipped; of two values one bit apart only that with a 0 there probes for the other."""
        flips = F.array(*(F.lit(m).cast("long") for m in (0, *(1 << b for b in range(self.width)))))
        return keys.withColumn("flip", F.explode(flips)).filter("key & flip = 0").withColumn("key", F.expr("key ^ flip"))

    def first_and_near(self, key: str, a: str, b: str) -> str:
        """Whether the fingerprints a and b are within the radius and meet in no segment before that of the key.

        In lambdas: written out for each word and segment, the join's method is too long for the JVM to compile.
        """
        each, mask = 64 // self.width, (1 << self.width) - 1
        word, offset = f"cast(i div {each} as int)", f"cast(i % {each} * {self.width} as int)"
        before = f"exists(sequence(0L, {len(self.segments) - 1}L), i -> i < shiftright({key}, 40) and bit_count(shiftrightunsigned({a}[{word}] ^ {b}[{word}], {offset}) & {mask}L) <= 1)"
        return f"{distance(a, b)} <= {self.radius} and not {before}"


def _near_pairs(nodes: DataFrame, plan: Plan, similarity: float) -> DataFrame:
    """Pairs (a, b, ra, rb, distance) of nodes (node, size, fp, root) of different roots that meet in a segment's ball and may be similar; distinct.

    The distance of their whole fingerprints is there where both carry them, else it is null.

    A key that very many nodes have is dealt among tasks. Those of its nodes with its commonest root meet
    the others only, in tasks that have a share of them each, so that a large group of near copies, which
    are of one root by then, is not compared with itself. A node that has a crowded key, as texts do that share
    passages but are no near copies, carries its whole fingerprint: two of these are a row only if the distance
    of their whole fingerprints allows it, and in the first segment in which they meet.
    """
    total = nodes.count()
    crowd, limit = CROWD * max(1, total >> plan.width), max(SPREAD_ROWS, total * len(plan.segments) // SPREAD_KEYS)
    by_root = plan.keys(nodes).groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    counts = save(by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main")).filter(F.col("n") > crowd))
    hot = counts.filter(F.col("n") > limit)
    crowded = join_spread(plan.keys(nodes), counts.select("key", "n"), ["key"], "n", ["node"]).select("node").distinct().withColumn("crowded", F.lit(True))
    keys = plan.keys(save(nodes.join(crowded, "node", "left").withColumn("whole", F.expr("if(crowded, fp, null)"))), "whole")
    condition = F.expr(
        f"p.root <> t.root and (p.flip <> 0 or p.node < t.node) and least(p.size, t.size) >= {similarity} * greatest(p.size, t.size)"
        f" and if(p.whole is null or t.whole is null, bit_count(p.other ^ t.other) <= {plan.word_radius}, {plan.first_and_near('p.key', 'p.whole', 't.whole')})"
    )

    def met(p: DataFrame, t: DataFrame, on: list[str]) -> DataFrame:
        both = p.alias("p").join(t.alias("t"), [F.col(f"p.{c}") == F.col(f"t.{c}") for c in on] + [condition])
        first = F.col("p.node") < F.col("t.node")
        roots = (F.when(first, F.col(f"{x}.root")).otherwise(F.col(f"{y}.root")).alias(r) for x, y, r in (("p", "t", "ra"), ("t", "p", "rb")))
        apart = F.expr(f"if(p.whole is null or t.whole is null, null, {distance('p.whole', 't.whole')})")
        return both.select(F.least("p.node", "t.node").alias("a"), F.greatest("p.node", "t.node").alias("b"), *roots, apart.alias("distance"))

    probes = plan.probes(keys)
    if hot.isEmpty():
        return met(probes, keys, ["key"]).distinct()
    copies = F.broadcast(hot.select("key", "main", F.ceil(F.col("n") / limit).cast("int").alias("copies")))
    every, mine = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)), F.pmod(F.xxhash64("node"), F.coalesce("copies", F.lit(1))).cast("int")
    others = probes.join(copies, "key", "left").filter("main is null or root <> main").withColumn("salt", every)
    all_ = keys.join(copies, "key", "left").withColumn("salt", mine)
    main = probes.join(copies, "key").filter("root = main").withColumn("salt", mine)
    rest = keys.join(copies, "key").filter("root <> main").withColumn("salt", every)
    return met(others, all_, ["key", "salt"]).unionByName(met(main, rest, ["key", "salt"])).distinct()


def _star_pairs(nodes: DataFrame, plan: Plan, similarity: float) -> DataFrame:
    """Pairs (a, b) of each node and the representative of those that share a segment's value, if they may be similar; distinct."""
    keys = plan.keys(nodes)
    first = F.min_by(F.struct("node", "size", "other"), F.struct(F.xxhash64("node"), "node"))
    shared = save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("rep")).filter("n > 1"))
    met = join_spread(keys, shared, ["key"], "n", ["node"]).filter(f"node <> rep.node and bit_count(other ^ rep.other) <= {plan.word_radius} and least(size, rep.size) >= {similarity} * greatest(size, rep.size)")
    return met.select(F.least("node", "rep.node").alias("a"), F.greatest("node", "rep.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, text_id, group_id, kept, rows) for each distinct document of (doc_id, text); group_id is its group's smallest doc_id.

    Texts with the same words are one node with one fingerprint of several words of 64 bits, made of
    its distinct shingles. Segments of it are an index (Plan): each node looks up the values of its own
    segments and those one bit away, and the distance of the whole fingerprints, then the exact similarity of
    the sets of shingles verify what it finds. First each node is compared with one representative of those
    that share a segment's value, which joins most of a group of near copies at once; then all pairs that
    meet are taken, but for those already joined: of two groups first the nearest pair, then, if
    that does not join them, all others. No pair that meets is left out.

    Documents are told apart by doc_id and text (text_id is a hash of it): rows that share an id but not a
    text are judged each for itself, repeated rows are one, and `rows` counts them. kept: the one
    document of a group that has the smallest doc_id (ties: the least text_id). Rows with a null doc_id take
    no part. Texts without words, null ones too, are alike. Texts of any length are hashed whole. An empty
    table gives no rows; further columns are not read.
    """
    plan = Plan(docs.count(), similarity)

    @F.pandas_udf("struct<fp: array<long>, size: int, h1: long, h2: long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            distinct = np.unique(shingle_hashes(t, width))  # sets are compared, whatever recurs how often
            words = b" ".join(t.encode().lower().split())
            out.append((fingerprint(distinct, plan.whole), len(distinct), *(xxhash.xxh64_intdigest(words, seed) - (1 << 63) for seed in (1, 2))))
        return pd.DataFrame(out, columns=["fp", "size", "h1", "h2"]).astype({"size": "int32", "h1": "int64", "h2": "int64"})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).filter("doc_id is not null").withColumn("text_id", F.xxhash64("text"))
    rows = save(own.select("doc_id", "text_id", described("text").alias("d")).select("doc_id", "text_id", "d.*"))
    by_text = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_id")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"))
    nodes = save(by_text.withColumn("node", F.monotonically_increasing_id()))
    alone = nodes.select("node", "size", "fp", F.col("node").alias("root"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b, ra, rb) that are similar."""
        pairs = save(pairs.select("a", "b", "ra", "rb"))
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        where = save(nodes.select("node", "first.*").join(ends, "node"))

        @F.pandas_udf("binary")
        def shingles(texts: pd.Series) -> pd.Series:
            return pd.Series([np.unique(shingle_hashes(t, width)).tobytes() for t in texts], dtype=object)

        texts = own.join(sided(where, SENT), ["doc_id", "text_id"]).dropDuplicates(["node"])
        held = save(texts.select("node", "n", shingles("text").alias("held")))

        @F.pandas_udf("boolean")
        def alike(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([_jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(a, b)], dtype=bool)

        one = join_spread(pairs, held.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("held").alias("ha")), ["a"], "na", ["b"])
        both = join_spread(one, held.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("held").alias("hb")), ["b"], "nb", ["a"])
        out = save(both.filter(alike("ha", "hb")).select("a", "b", "ra", "rb"))
        discard(held)
        discard(pairs)
        return out

    placed = _joined(alone, verified(_whole_distance(_star_pairs(alone, plan, similarity), alone, plan.radius)))
    met = save(_near_pairs(placed, plan, similarity))
    found = save(met.filter("distance is not null").unionByName(_whole_distance(met.filter("distance is null").select("a", "b"), placed, plan.radius)))
    discard(met)
    if not found.isEmpty():
        groups = [F.least("ra", "rb").alias("one"), F.greatest("ra", "rb").alias("two")]
        nearest = found.groupBy(*groups).agg(F.min(F.struct("distance", "a", "b", "ra", "rb")).alias("m")).select("m.a", "m.b", "m.ra", "m.rb")
        placed = _joined(placed, verified(nearest))
        root_of = lambda c: placed.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        left = found.select("a", "b").join(nearest.select("a", "b"), ["a", "b"], "left_anti").join(root_of("a"), "a").join(root_of("b"), "b")
        left = save(left.filter("ra <> rb"))
        if not left.isEmpty():
            placed = _joined(placed, verified(left))
    grouped = nodes.select("node", "h1", "h2", "first", "n").join(placed.select("node", "root"), "node")
    least = grouped.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members"))
    by_node = save(join_spread(grouped, least, ["root"], "members", ["node"]).select("h1", "h2", "n", "least"))
    single = rows.groupBy("doc_id", "text_id", "h1", "h2").agg(F.count(F.lit(1)).alias("rows"))
    out = join_spread(single, by_node, ["h1", "h2"], "n", ["doc_id", "text_id"])
    return out.select("doc_id", "text_id", F.col("least.doc_id").alias("group_id"), (F.struct("doc_id", "text_id") == F.col("least")).alias("kept"), "rows")


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed (node, size, fp, root) with the roots that links (ra, rb) between them join; only they are gone through, not all that was joined before."""
    roots = connected_components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).withColumnsRenamed({"root": "joined", "node": "root"})
    members = placed.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    moved = save(roots.join(members, "root"))
    return save(join_spread(placed, moved, ["root"], "members", ["node"], "left").select("node", "size", "fp", F.coalesce("joined", "root").alias("root")))


def _whole_distance(pairs: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """pairs (a, b) with the `distance` of their whole fingerprints and the roots ra and rb, if that is within the radius."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fp").alias(f"f{c}"), F.col("root").alias(f"r{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("distance", F.expr(distance("fa", "fb"))).filter(F.col("distance") <= radius).select("a", "b", "ra", "rb", "distance")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near_duplicates() the document that is kept, once, and rows with a null doc_id."""
    doc, text, rows = free_names(docs, "doc", "text", "rows")
    firsts = groups.filter("kept").select(F.col("doc_id").alias(doc), F.col("text_id").alias(text), F.col("rows").alias(rows))
    kept = docs.join(firsts, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(text_of(docs["text"])) == F.col(text)))
    once = kept.filter(F.col(rows) == 1).unionByName(kept.filter(F.col(rows) > 1).dropDuplicates([doc, text]))
    return once.select(docs.columns).unionByName(docs.filter(docs["doc_id"].isNull()))
