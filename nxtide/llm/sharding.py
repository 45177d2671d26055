"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations."""

from __future__ import annotations

from math import exp, floor, lgamma, log, log1p, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nxtide.llm.common import free_names, without

#: Partitions that rows come from and random strata in a shard, at least; rows of one where there are more; cells of the matrix at most.
PARTS, STRATA, ROWS, CELLS = 512, 16, 1 << 22, 1 << 22


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows go from each partition to each shard: a draw without replacement, as if all rows had been shuffled.

    Shard sizes differ by one at most; which shards get one more is drawn too.
    """
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    matrix = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        rest = int(n)
        for j in range(shards - 1):  # the marginals of a multivariate hypergeometric draw, one shard after another
            others = int(left[j + 1 :].sum())
            matrix[i, j] = _draw(rng, int(left[j]), others, rest)
            rest -= int(matrix[i, j])
        matrix[i, shards - 1] = rest
        left -= matrix[i]
    return matrix


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n things drawn without replacement are good ones. NumPy draws this for fewer than 10^9 of each; the law is the same beyond."""
    return int(rng.hypergeometric(good, bad, n)) if max(good, bad) < 10**9 else _draw_large(rng, good, bad, n)


def _draw_large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact draw for any numbers: the law is log-concave, so Devroye's rejection works, with a step around
    the mode and exponential tails to cover it and the exact chance to decide. It takes some 0.4 ms.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    top = _log_chance(mode, good, bad, n)
    p = exp(top)
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() <= w / (1 + w) else (w + rng.exponential()) / p
        x = mode + (1 if rng.random() < 0.5 else -1) * floor(y + 0.5)
        if low <= x <= high and log(1 - rng.random()) + min(0.0, w - p * y) <= _log_chance(x, good, bad, n) - top:
            return x


def _log_chance(x: int, good: int, bad: int, n: int) -> float:
    """The logarithm of the hypergeometric chance of x, by binomial ones, whose large terms cancel before they are rounded (Loader's method)."""
    return _log_binomial(x, good, n, good + bad) + _log_binomial(n - x, bad, n, good + bad) - _log_binomial(n, good + bad, n, good + bad)


def _log_binomial(x: int, n: int, a: int, b: int) -> float:
    """The logarithm of the chance of x out of n, each with chance a / b."""
    if x == 0 or x == n:
        return n * (log1p(-a / b) if x == 0 else log(a / b)) if 0 < a < b else 0.0
    middle = _rest(n) - _rest(x) - _rest(n - x) - _apart(x, n * a, b) - _apart(n - x, n * (b - a), b)
    return middle - 0.5 * (log(2 * pi) + log(x) + log1p(-x / n))


def _rest(n: int) -> float:
    """What Stirling's formula leaves of the logarithm of n factorial."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _apart(x: int, numerator: int, denominator: int) -> float:
    """x log(x / m) + m - x for m = numerator / denominator, without loss where both are close."""
    m, d = numerator / denominator, (x * denominator - numerator) / denominator
    if abs(d) >= 0.1 * (x + m):
        return x * log(x / m) - d
    v = d / (x + m)
    total, term, j = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def shuffle_to_shards(rows: DataFrame, identity: list[str], shards: int, seed: int = 7, rows_in_part: int = ROWS) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard) to rows; sizes of shards differ by one at most.

    identity: the columns that tell rows apart. Rows equal in them may trade places, which
    changes nothing; they are in one partition. A row's partition and its places in both permutations
    are hashes of them and the seed, so a task that runs again makes the same rows. Partitions and strata
    hold about `rows_in_part` rows, as long as the matrix has no more than CELLS cells. Only the counts of
    partitions reach the driver; the matrix comes back with a row for each, and so is broadcast. A first
    window permutes each partition and deals its rows out by the matrix's row; a second one permutes
    each of a shard's strata, whose offsets are sums of at most shards x strata counts. All draws are
    exact, for any number of rows. Nulls are values like others; ties between hashes go by identity; an
    empty table stays empty. Columns `shard` and `slot` of rows are replaced.
    """
    spark = rows.sparkSession
    rows = rows.select(without(rows, "shard", "slot"))
    ids = [F.col(c) for c in identity]
    part, first, second, rank, upto, start, stratum = free_names(rows, "part", "first", "second", "rank", "upto", "from", "stratum")
    total = rows.count()
    parts = max(1, min(max(PARTS, -(-total // rows_in_part)), CELLS // shards))
    strata = max(STRATA, -(-total // (shards * rows_in_part)))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(parts)).cast("int"))
    counts = dict(dealt.groupBy(part).count().collect())
    sizes = [counts.get(i, 0) for i in range(parts)]
    cuts = communication_matrix(sizes, shards, seed).cumsum(axis=1).tolist()
    matrix = spark.createDataFrame(list(enumerate(cuts)), f"{part} int, {upto} array<long>")
    local = W.partitionBy(part).orderBy(first, *identity)
    placed = (
        dealt.withColumn(first, F.xxhash64(F.lit(seed + 1), *ids))
        .withColumn(rank, F.row_number().over(local))
        .join(F.broadcast(matrix), part)
        .withColumn("shard", F.size(F.filter(upto, lambda c: c < F.col(rank))).cast("int"))
        .withColumn(second, F.xxhash64(F.lit(seed + 2), *ids))
        .withColumn(stratum, F.pmod(F.xxhash64(F.lit(seed + 3), *ids), F.lit(strata)).cast("int"))
        .drop(part, first, rank, upto)
    )
    by_stratum = placed.groupBy("shard", stratum).count()
    before = W.partitionBy("shard").orderBy(stratum).rowsBetween(W.unboundedPreceding, -1)
    offsets = by_stratum.select("shard", stratum, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    inside = W.partitionBy("shard", stratum).orderBy(second, *identity)
    return placed.withColumn("slot", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", stratum]).withColumn("slot", F.col("slot") + F.col(start) - 1).select(*rows.columns, "shard", F.col("slot").cast("long").alias("slot"))
