"""Simulations: Monte-Carlo grids and synthetic daily traffic. Each row has its own seed, so a task that runs again draws the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monte_carlo(grid: DataFrame, repeats: int, seed: int, slots: int = 24) -> DataFrame:
    """For each row of grid (mean_fp, sd_fp, mean_tp, sd_tp, th) and repeat: the shares of slots above the threshold, with and without infection."""
    runs = grid.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_seed", F.xxhash64(F.lit(seed), *grid.columns, "repeat"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                rng = np.random.default_rng(r[-1] & ((1 << 63) - 1))
                fp = np.maximum(0, np.ceil(rng.normal(r.mean_fp, r.sd_fp, slots)))
                tp = np.maximum(0, np.ceil(rng.normal(r.mean_tp, r.sd_tp, slots)))
                out.append((float((fp > r.th).mean()), float((fp + tp > r.th).mean())))
            yield f.drop(columns="_seed").assign(fpr=[a for a, _ in out], tpr=[b for _, b in out])

    schema = ", ".join(f"{c} {t}" for c, t in runs.drop("_seed").dtypes)
    return runs.mapInPandas(draw, f"{schema}, fpr double, tpr double")


def daily_traffic(days: DataFrame, seed: int, mean: float = 1000.0, peak: float = 14.0, spread: float = 4.0, noise: float = 0.1) -> DataFrame:
    """(day, hour, requests) for days (day): a Gaussian over the hours of a day, with relative noise."""
    hours = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    shape = mean * F.exp(-F.pow(F.col("hour") - peak, 2) / (2 * spread * spread))
    # a normal draw from two hashes, so that it depends on the row alone
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "day", "hour"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40) + 1) for k in (1, 2)]
    normal = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * np.pi * u[1])
    return hours.withColumn("requests", F.greatest(F.lit(0), F.ceil(shape * (1 + noise * normal))))


def sobol_first_order(samples: DataFrame, parameters: list[str], value: str, bins: int = 16) -> DataFrame:
    """(parameter, index): the variance of a parameter's conditional means, by equal-width bins, over the whole variance."""
    total = samples.agg(F.var_pop(value).alias("_v"), F.avg(value).alias("_m"))
    ends = samples.agg(*(F.struct(F.min(p).alias("lo"), F.max(p).alias("hi")).alias(f"_{p}") for p in parameters))
    cells = samples.crossJoin(F.broadcast(ends)).withColumns({f"_bin_{p}": F.least(F.floor(bins * F.try_divide(F.col(p) - F.col(f"_{p}.lo"), F.col(f"_{p}.hi") - F.col(f"_{p}.lo"))), F.lit(bins - 1)) for p in parameters})
    longer = cells.select(value, *(F.col(f"_bin_{p}").alias(p) for p in parameters)).unpivot([value], parameters, "parameter", "bin")
    means = longer.groupBy("parameter", "bin").agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.crossJoin(F.broadcast(total)).groupBy("parameter").agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("_m"), 2)) / F.sum("n") / F.first("_v")).alias("index"))
