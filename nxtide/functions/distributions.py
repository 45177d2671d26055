"""Distribution functions that Spark has no expression for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("double")
def normal_cdf(x: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    z = ((x - mean) / (sd * math.sqrt(2))).to_numpy(float)
    return pd.Series([0.5 * (1 + math.erf(v)) for v in z])


@F.pandas_udf("double")
def normal_quantile(p: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    unit = NormalDist()
    return pd.Series([m + s * unit.inv_cdf(q) if 0 < q < 1 else math.copysign(math.inf, q - 0.5) for q, m, s in zip(p, mean, sd)])


@F.pandas_udf("double")
def negative_binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k) failures before the n-th success."""

    def one(k: float, n: float, p: float) -> float:
        if k < 0:
            return 0.0
        i = np.arange(int(k) + 1)
        logs = [math.lgamma(n + j) - math.lgamma(n) - math.lgamma(j + 1) for j in i]
        return float(np.exp(np.array(logs) + n * math.log(p) + i * math.log1p(-p)).sum()) if p < 1 else 1.0

    return pd.Series([one(*t) for t in zip(k, n, p)])
