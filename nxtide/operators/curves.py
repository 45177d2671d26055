"""ROC curves and areas, by sorting partial counts of distinct scores in buckets of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nxtide.operators.scratch import save

#: Buckets of near equally many thresholds, each sorted by a task of its own.
BUCKETS = 256


def _bucketed(points: DataFrame, by: tuple) -> DataFrame:
    """points with _bucket, which rises with the threshold: the number of approximate quantiles below it."""
    return _in_buckets(points, _bounds(points, by), by).drop("_bounds")


def _bounds(points: DataFrame, by: tuple, sums: tuple = ()) -> DataFrame:
    """A row (by, _bounds and the sums of columns) for each value of by: approximate quantiles of its thresholds."""
    quantiles = F.percentile_approx("threshold", [i / BUCKETS for i in range(1, BUCKETS)]).alias("_bounds")
    return points.groupBy(*by).agg(quantiles, *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in sums))


def _in_buckets(points: DataFrame, bounds: DataFrame, by: tuple) -> DataFrame:
    joined = points.join(bounds, list(by)) if by else points.crossJoin(F.broadcast(bounds))
    return joined.withColumn("_bucket", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("threshold"))), F.lit(0)))


def _with_neighbour(points: DataFrame, by: tuple, names: dict[str, str], after: bool = False) -> DataFrame:
    """points (with _bucket) with columns of the point before, or after, in falling order of the threshold, under the given names.

    Within a bucket that is a lag; the first point of a bucket has the last one of the bucket before it, of which there is a row each.
    """
    shift, end = (F.lead, F.max_by) if after else (F.lag, F.min_by)
    ends = points.groupBy(*by, "_bucket").agg(end(F.struct(*names), "threshold").alias("_end"))
    ends = ends.select(*by, "_bucket", shift("_end").over(W.partitionBy(*by).orderBy(F.desc("_bucket"))).alias("_end"))
    within = shift(F.struct(*names)).over(W.partitionBy(*by, "_bucket").orderBy(F.desc("threshold")))
    met = points.withColumn("_within", within).join(ends, [*by, "_bucket"])
    near = F.coalesce("_within", "_end")
    return met.select(*points.columns, *(near[c].alias(name) for c, name in names.items()))


def roc(df: DataFrame, label: str, score: str, by: tuple = (), drop_intermediate: bool = False) -> DataFrame:
    """(by, threshold, tp, fp, tpr, fpr): a point for each distinct score, highest first, after one at infinity.

    Rows are counted for each distinct score first; the running sums are over those counts, within buckets
    that start at the sums of the buckets above them, so that no task sorts all scores.
    With drop_intermediate, points on a straight line between their neighbours are left out.
    """
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    counts = save(counts)  # bounds, sums and points are made of it: df is read once
    totals = _bounds(counts, by, ("p", "n"))
    totals = totals.dropna(subset=list(by)) if by else totals
    counts = _in_buckets(counts, totals, by)
    above = W.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.groupBy(*by, "_bucket").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    starts = starts.select(*by, "_bucket", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}0") for c in ("p", "n")))
    running = W.partitionBy(*by, "_bucket").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    tp, fp = (F.sum(c).over(running) + F.col(f"_{c}0") for c in ("p", "n"))
    points = counts.join(starts, [*by, "_bucket"]).select(*by, F.col("threshold").cast("double").alias("threshold"), tp.alias("tp"), fp.alias("fp"), "_p", "_n")
    none = F.lit(0).cast("long")
    points = points.unionByName(totals.select(*by, F.lit(float("inf")).alias("threshold"), none.alias("tp"), none.alias("fp"), "_p", "_n"))
    if drop_intermediate:
        points = _with_neighbour(_bucketed(points, by), by, {"tp": "_tp0", "fp": "_fp0"})
        points = _with_neighbour(points, by, {"tp": "_tp1", "fp": "_fp1"}, after=True)
        flat = F.expr("_tp1 - tp = tp - _tp0 and _fp1 - fp = fp - _fp0")
        points = points.filter(~F.coalesce(flat, F.lit(False)))
    return points.select(*by, "threshold", "tp", "fp", F.try_divide("tp", "_p").alias("tpr"), F.try_divide("fp", "_n").alias("fpr"))


def _steps(points: DataFrame, by: tuple) -> DataFrame:
    """points with the rates of the point before: _x0 and _y0. They are read for the bounds of buckets, for their ends and for themselves."""
    points = save(points)
    return _with_neighbour(_bucketed(points, by), by, {"fpr": "_x0", "tpr": "_y0"})


def auc(points: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, auc): the area by trapezoids."""
    area = (F.col("fpr") - F.col("_x0")) * (F.col("tpr") + F.col("_y0")) / 2
    return _steps(points, by).withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("auc"))


def partial_auc(points: DataFrame, max_fpr: float, by: tuple = ()) -> DataFrame:
    """(by, raw, standardised): the area up to max_fpr, interpolated there, and McClish's form of it."""
    x0, y0, x1, y1 = F.col("_x0"), F.col("_y0"), F.col("fpr"), F.col("tpr")
    end = F.least(x1, F.lit(max_fpr))
    height = F.when(x1 == x0, y1).otherwise(y0 + (y1 - y0) * F.try_divide(end - x0, x1 - x0))
    area = F.when(x0 <= max_fpr, (end - x0) * (y0 + height) / 2).otherwise(0.0)
    least = 0.5 * max_fpr**2
    return _steps(points, by).withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("raw")).withColumn("standardised", 0.5 * (1 + (F.col("raw") - least) / (max_fpr - least)))


def best_threshold(points: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, threshold, gain): where tpr - fpr is largest; of equal ones the highest threshold."""
    gain = F.col("tpr") - F.col("fpr")
    return points.groupBy(*by).agg(F.max_by(F.struct("threshold", gain.alias("gain")), F.struct(F.round(gain, 12), "threshold")).alias("b")).select(*by, "b.*")


def detection_shares(df: DataFrame, value: str, limits: DataFrame) -> DataFrame:
    """(th, share): the share of rows above each threshold of a small table, broadcast."""
    return df.crossJoin(F.broadcast(limits)).groupBy("th").agg(F.avg((F.col(value) > F.col("th")).cast("double")).alias("share"))


def kernel_density(df: DataFrame, value: str, at: DataFrame, width: float) -> DataFrame:
    """at (at, further columns; a few points, as each meets all rows) with the Gaussian kernel density of a column there."""
    spread = F.exp(-F.pow((F.col("at") - F.col(value)) / width, F.lit(2)) / 2)
    met = df.select(value).filter(F.col(value).isNotNull()).crossJoin(F.broadcast(at))
    return met.groupBy(*at.columns).agg((F.avg(spread) / F.lit(width * 2.5066282746310002)).alias("density"))
