import pytest
from oracle import same

from nxtide.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, name):
    same(spark, tiny, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - SQL.keys()))
def test_query_without_sql_runs(spark, tiny, name):
    df = registry.queries()[name](spark, tiny)
    assert df.count() > 0


def test_distributions_equal_plain_formulas(spark, tiny):
    import math
    from statistics import NormalDist

    sizes = {r["p_partkey"]: r["p_size"] / 50 for r in spark.read.parquet(f"{tiny}/part.parquet").select("p_partkey", "p_size").collect()}
    for r in registry.queries()["mth5_mth6_distributions"](spark, tiny).collect():
        x = sizes[r["p_partkey"]]
        assert abs(r["cdf"] - NormalDist().cdf(x)) < 1e-6 and abs(r["quantile"] - NormalDist().inv_cdf(x * 0.98 + 0.01)) < 1e-6
        assert abs(r["nbinom"] - sum(math.comb(4 + j, j) * 0.4**5 * 0.6**j for j in range(math.floor(x * 10) + 1))) < 1e-6


def test_random_split_keeps_all_rows(spark, tiny):
    from nxtide.plans.relational import series

    parts = {r["part"]: r["n"] for r in registry.queries()["an31_random_split"](spark, tiny).collect()}
    total = series(spark, tiny).count()
    assert sum(parts.values()) == total and 0.1 * total < parts["train"] < 0.3 * total


def test_markdown_says_what_it_leaves_out(spark):
    from nxtide.operators.service import markdown

    assert markdown(spark.range(3)).count("\n") == 4 and markdown(spark.range(3), 2).endswith("(only the first 2 rows)")
