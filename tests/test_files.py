"""Files and views that queries make: existence, lists of JSON."""

import pytest
from oracle import same

from nxtide.operators import service
from nxtide.plans import registry


def test_existence_query_equals_sql(spark, tiny):
    same(spark, tiny, registry.queries()["snk13_existence_and_count"], registry.oracle_sql()["snk13_existence_and_count"])
    spark.range(1).createOrReplaceTempView("nx_there")
    assert service.exists(spark, "nx_there") and not service.exists(spark, "nx_not_there")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_each_file_holds_one_json_list(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)  # without it lists are written by several tasks
    try:
        name = "src17_library_json"
        same(spark, "/root/testdata/sf0.1", registry.queries()[name], registry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
