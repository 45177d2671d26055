"""Approximate nearest neighbours: a hierarchical k-means tree, grown level by level in Spark, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nxtide.llm.common import discard, save

#: Vectors that the tree's top is fitted to, queries that calibrate it, children of a node, and the recall to reach.
SAMPLE, PROBES, BRANCH, RECALL = 16384, 256, 8, 0.95
#: Rows that a leaf should hold at most (fewer in a small table, for LEAST_LEAVES or so), and rows of a leaf's sample for each child that it is split into.
ROWS, LEAST_LEAVES, FIT = 512, 32, 128
#: Leaves at most, as each task holds the tree (some 4 bytes a dimension and leaf). Beyond MOST_LEAVES x ROWS rows leaves are larger.
MOST_LEAVES = 1 << 16
#: Groups of neighbouring leaves that vectors are dealt into at least, the numbers that one may hold (a group's vectors, or a block of
#: them, are in memory together), queries that visit a group and are in memory together, and those of them that are scored together.
GROUPS, VALUES, QUERIES, SCORED = 16, 1 << 22, 1024, 64


@dataclass
class Tree:
    """centres[i] are the centres of node i's children, children[i] their nodes; a child below zero is leaf -1 - child."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 1

    def split(self, centres: dict[int, np.ndarray]) -> None:
        """Puts a node in the place of each of these leaves; its first child keeps the leaf's number."""
        at = {child: (kids, k) for kids in self.children for k, child in enumerate(kids) if child < 0}
        for leaf, c in centres.items():
            node = len(self.centres)
            if (place := at.get(-1 - leaf)) is not None:
                place[0][place[1]] = node
            self.centres.append(c.astype(np.float32))
            self.children.append([-1 - leaf, *(-1 - (self.leaves + k) for k in range(len(c) - 1))])
            self.leaves += len(c) - 1

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, seed: int = 5) -> Tree:
        """A tree whose leaves hold `rows` of x at most, or vectors that are all the same."""
        rng, tree = np.random.default_rng(seed), cls()
        todo = [(0, np.arange(len(x)))]
        while todo:
            leaf, own = todo.pop()
            if len(own) > rows:
                centres, at = _kmeans(x[own], min(BRANCH, -(-len(own) // rows)), rng)
                if len(centres) > 1:
                    first = tree.leaves
                    tree.split({leaf: centres})
                    todo += [(leaf if k == 0 else first + k - 1, own[at == k]) for k in range(len(centres))]
        return tree

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector belongs to: from the root, always on to the nearest centre."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            at = _nearest(x[rows], self.centres[node].astype(np.float64))
            for k, child in enumerate(self.children[node]):
                mine = rows[at == k]
                if child < 0:
                    out[mine] = -1 - child
                elif len(mine):
                    todo.append((child, mine))
        return out

    def bins(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best first: a queue holds the branches not yet taken, by the product of q with their centres."""
        if not self.centres:
            yield 0
            return
        q = q.astype(np.float32)
        queue, serial = [(0.0, 0, 0)], count(1)
        while queue:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for s, child in zip((self.centres[node] @ q).tolist(), self.children[node]):
                heapq.heappush(queue, (-s, next(serial), child))

    def in_order(self) -> list[int]:
        """The leaves, those of a branch side by side."""
        out, todo = [], [0 if self.centres else -1]
        while todo:
            node = todo.pop()
            if node < 0:
                out.append(-1 - node)
            else:
                todo += reversed(self.children[node])
        return out

    def best_bins(self, q: np.ndarray, visits: int, counts: np.ndarray, least: int) -> list[int]:
        """Leaves, best first: `visits` of them, and on until they hold `least` vectors by counts, or there are no more."""
        out, held = [], 0
        for leaf in self.bins(q):
            out.append(leaf)
            held += counts[leaf]
            if len(out) >= visits and held >= least:
                break
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres, and the place of each row's; fewer than k where rows are the same."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        used = np.unique(at)
        centres = np.stack([x[at == j].mean(axis=0) for j in used])
    at = _nearest(x, centres)
    used = np.unique(at)
    return centres[used], np.searchsorted(used, at)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision; each is the same whatever else is in `rows`."""
    return (rows * q).sum(axis=1)


def _top(q: np.ndarray, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of the k best of rows for q but for `own`; rough: products that may be off in their last digits, -inf for rows that are left out."""
    other = np.flatnonzero((ids != own) & (rough > -np.inf))
    if len(other) > k:
        least = np.partition(rough[other], len(other) - k)[len(other) - k]
        other = other[rough[other] >= least - 1e-9 * (1 + abs(least))]
    exact = products(q, rows[other])
    best = np.lexsort((ids[other], -exact))[:k]
    return other[best], exact[best]


def _counts(held: DataFrame, leaves: int) -> np.ndarray:
    out = np.zeros(leaves, np.int64)
    for row in held.groupBy("leaf").count().collect():  # a row for each leaf, MOST_LEAVES at most
        out[row["leaf"]] = row["count"]
    return out


@dataclass
class NearestIndex:
    """A tree, the number of leaves that a search visits at least, all vectors (vec_id, v, leaf), and their number in each leaf.

    recall: the share of the calibrating queries' true neighbours that lie within that many leaves.
    """

    tree: Tree
    visits: int
    vectors: DataFrame
    recall: float
    counts: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, k: int = 20, recall: float = RECALL, sample: int = SAMPLE, probes: int = PROBES, rows: int = ROWS, most_leaves: int = MOST_LEAVES) -> NearestIndex:
        """Indexes each row of vectors (vec_id, embedding).

        The tree's top is fitted to a bounded sample; then, level by level, each leaf that holds
        more than twice `rows` rows of the table is split, fitted in a task of its own to a sample
        of its rows, until none does or its vectors are all the same: the tree grows with the table.

        Null vectors, zero ones, and those with null or non-finite components take no part, nor
        do null ids, nor vectors not of the commonest length (ties: the longer), which have no
        inner product with the others. Repeated rows are rows each. Visits are widened until the mean
        recall over `probes` sampled queries, against exact search over all vectors, is reached: each
        true neighbour's leaf has a place in the order of leaves. The probes are none of the
        vectors that the tree is fitted to, if there are two or more. An empty table has an empty index.
        """
        spark = vectors.sparkSession
        kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
        fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).filter("vec_id is not null and v is not null").filter(fit)
        widths = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        if widths is None:
            return cls(Tree(), 1, valid.withColumn("leaf", F.lit(0).cast("long")), 1.0, np.zeros(1, np.int64))
        valid, rows = valid.filter(F.size("v") == widths["n"]), min(rows, max(16, widths["count"] // LEAST_LEAVES))
        drawn = valid.orderBy(F.xxhash64("vec_id", F.lit("tree")), "vec_id").limit(sample + probes).toPandas()
        apart = min(probes, len(drawn) // 2)
        asked, fitted = drawn.head(max(1, apart)), drawn[apart:]
        # a leaf of the top should hold about `rows` of the table, but is not fitted to fewer than FIT of the sample
        share = len(fitted) / max(1, widths["count"])
        tree = Tree.fit(_matrix(fitted["v"]), max(int(rows * share), min(FIT, rows)))
        held = save(valid.mapInPandas(_assigning(spark.sparkContext.broadcast(tree)), f"vec_id long, v {kind}, leaf long"))
        counts, done = _counts(held, tree.leaves), set()
        while over := [i for i in np.flatnonzero(counts > 2 * rows).tolist() if i not in done][: max(0, most_leaves - tree.leaves) // (BRANCH - 1)]:
            split = _split(held, {i: int(counts[i]) for i in over}, rows, asked["vec_id"].tolist())
            done.update(i for i in over if i not in split)
            if split:
                tree.split(split)
                moved = save(held.mapInPandas(_assigning(spark.sparkContext.broadcast(tree), set(split)), held.schema))
                discard(held)
                held, counts = moved, _counts(moved, tree.leaves)
        found = _true_leaves(held, _matrix(asked["v"]), asked["vec_id"].to_numpy(), k)
        places = []
        for q, wanted in zip(_matrix(asked["v"]), found):
            rest = dict.fromkeys(wanted)
            for place, leaf in enumerate(tree.bins(q)):
                if not rest:
                    break
                if leaf in rest:
                    places += [place] * wanted.count(leaf)
                    del rest[leaf]
        at = np.sort(np.array(places, np.int64))
        visits = int(at[int(np.ceil(recall * len(at))) - 1]) + 1 if len(at) else 1
        return cls(tree, visits, held, float((at < visits).mean()) if len(at) else 1.0, counts)

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, rank, vec_id, score, scored, calibrated_recall): the k nearest found of each of queries (vec_id, v), other than itself.

        There are fewer only if there are fewer: a query goes on beyond `visits` leaves until they hold
        k vectors and as many as have its id. Ties go to the smaller vec_id. Of several queries with an id
        the one with the least vector counts. scored: the vectors that its leaves hold.

        Neighbouring leaves are a group of a bounded number of vectors; the vectors of a leaf that holds more are dealt
        into blocks by a hash of their ids, and the queries that visit a group into parts likewise. A block and a part
        meet in one task, which scores each query with the vectors of its own leaves and gives at most k rows for it.
        """
        spark, visits, counts = queries.sparkSession, self.visits, self.counts
        width = self.vectors.select(F.size("v")).first()
        most = VALUES // max(1, width[0] if width else 1)
        size = max(1, min(most, int(counts.sum()) // GROUPS))
        order = np.array(self.tree.in_order())
        group = np.empty(len(order), np.int64)
        group[order] = (np.cumsum(counts[order]) - counts[order]) // size
        sent = spark.sparkContext.broadcast((self.tree, counts, group))

        @F.pandas_udf("array<struct<grp: long, leaves: array<long>, scored: long>>")
        def bins(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            tree, counts, group = sent.value
            for column, own in frames:
                out = []
                for v, n in zip(column, own):
                    leaves = np.array(tree.best_bins(np.asarray(v, np.float64), visits, counts, k + n))
                    seen = int(counts[leaves].sum())
                    out.append([{"grp": int(g), "leaves": leaves[group[leaves] == g].tolist(), "scored": seen} for g in np.unique(group[leaves])])
                yield pd.Series(out)

        repeated = self.vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_own")).filter("_own > 1")
        single = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
        asked = single.join(repeated, "vec_id", "left").select("vec_id", "v", F.explode(bins("v", F.coalesce("_own", F.lit(1)).cast("long"))).alias("b"))
        asked = save(asked.select("vec_id", "v", "b.grp", "b.leaves", "b.scored"))
        # a row for each leaf or group, MOST_LEAVES at most
        parts = F.broadcast(asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")))
        held = np.bincount(group, counts, int(group.max()) + 1)
        blocks = F.broadcast(spark.createDataFrame([(i, max(1, -(-int(n) // most))) for i, n in enumerate(held.tolist())], "grp long, blocks int"))
        places = F.broadcast(spark.createDataFrame(list(enumerate(group.tolist())), "leaf long, grp long"))

        def dealt(rows: DataFrame, mine: str, others: str, salt: str) -> DataFrame:
            own = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(f"{mine}s")).cast("int").alias(mine)
            both = rows.join(parts, "grp").join(blocks, "grp")
            return both.select(*rows.columns, own, F.explode(F.sequence(F.lit(0), F.col(f"{others}s") - 1)).alias(others))

        def scored(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
            out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
            if len(qs) and len(xs):
                xs = xs.sort_values("leaf", kind="stable")
                x, ids, leaf = _matrix(xs["v"]), xs["vec_id"].to_numpy(), xs["leaf"].to_numpy()
                leaves, starts = np.unique(leaf, return_index=True)
                ends = np.append(starts[1:], len(leaf))
                for i in range(0, len(qs), SCORED):
                    some = qs.iloc[i : i + SCORED]
                    q, rough = _matrix(some["v"]), np.full((len(some), len(ids)), -np.inf)
                    wanted = np.stack([np.isin(leaves, w) for w in some["leaves"]])
                    for j, (a, b) in enumerate(zip(starts, ends)):
                        who = np.flatnonzero(wanted[:, j])
                        if len(who):
                            rough[who, a:b] = q[who] @ x[a:b].T
                    for n, (own, seen) in enumerate(zip(some["vec_id"].tolist(), some["scored"].tolist())):
                        at, score = _top(q[n], ids, x, rough[n], own, k)
                        out.append((np.full(len(at), own), ids[at], score, np.full(len(at), seen)))
            return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "vec_id", "score", "scored"))})

        key = ["grp", "part", "block"]
        met = dealt(asked, "part", "block", "queries").groupBy(*key).cogroup(dealt(self.vectors.join(places, "leaf"), "block", "part", "rows").groupBy(*key))
        found = met.applyInPandas(scored, "query_id long, vec_id long, score double, scored long")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "scored", F.lit(self.recall).alias("calibrated_recall"))


def _assigning(tree, only: set[int] | None = None):
    """Gives vectors their leaf; if `only`, those alone that are in one of these leaves."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if only is None:
                yield f.assign(leaf=tree.value.leaf_of(_matrix(f["v"])) if len(f) else 0)
                continue
            leaf = f["leaf"].to_numpy().copy()
            move = np.isin(leaf, list(only))
            if move.any():
                leaf[move] = tree.value.leaf_of(_matrix(f["v"][move]))
            yield f.assign(leaf=leaf)

    return assign


def _split(held: DataFrame, sizes: dict[int, int], rows: int, probes: list[int]) -> dict[int, np.ndarray]:
    """Centres that split leaves of these sizes, each fitted in a task to some FIT x BRANCH of its rows; none for a leaf of equal vectors."""
    spark = held.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i, min(1.0, FIT * BRANCH / n), min(BRANCH, -(-n // rows))) for i, n in sizes.items()], "leaf long, share double, k int"))
    drawn = held.join(wanted, "leaf").filter((F.rand(11) < F.col("share")) & ~F.col("vec_id").isin(probes)).drop("share")

    def centres(f: pd.DataFrame) -> pd.DataFrame:
        leaf = int(f["leaf"].iloc[0])
        found, _ = _kmeans(_matrix(f["v"]), int(f["k"].iloc[0]), np.random.default_rng(leaf))
        return pd.DataFrame({"leaf": [leaf], "centres": [found.ravel()], "n": [len(found)]})

    made = drawn.groupBy("leaf").applyInPandas(centres, "leaf long, centres array<double>, n int").collect()
    return {r["leaf"]: np.array(r["centres"]).reshape(r["n"], -1) for r in sorted(made, key=lambda r: r["leaf"]) if r["n"] > 1}


def _true_leaves(held: DataFrame, q: np.ndarray, own: np.ndarray, k: int) -> list[list[int]]:
    """The leaves of the k nearest vectors of each of a bounded number of queries, by exact search over all."""
    asked = held.sparkSession.sparkContext.broadcast((q, own))

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, own = asked.value
        for f in frames:
            if not len(f):
                continue
            x, ids, leaf = _matrix(f["v"]), f["vec_id"].to_numpy(), f["leaf"].to_numpy()
            rough = q @ x.T
            found = [_top(q[i], ids, x, rough[i], own[i], k) for i in range(len(q))]
            at = np.concatenate([a for a, _ in found])
            yield pd.DataFrame({"probe": np.repeat(np.arange(len(q)), [len(a) for a, _ in found]), "score": np.concatenate([b for _, b in found]), "vec_id": ids[at], "leaf": leaf[at]})

    rank = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    out: list[list[int]] = [[] for _ in own]
    for r in held.mapInPandas(exact, "probe int, score double, vec_id long, leaf long").withColumn("r", rank).filter(F.col("r") <= k).select("probe", "leaf").collect():
        out[r["probe"]].append(r["leaf"])
    return out
