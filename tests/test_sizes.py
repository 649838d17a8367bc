"""Steps whose memory must not grow with the input: partitions become more as rows do, and results stay."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia import storage
from marginalia.operators import curation
from marginalia.plans import registry

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["coauthors", "mention_credit"])
def test_partitions_grow_with_rows(spark, monkeypatch, name):
    monkeypatch.setattr(storage, "ROWS_A_PART", 2000)
    got = registry.queries()[name](spark, D)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert storage.parts(60000) == 31 and "31), REPARTITION_BY_NUM" in plan
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = duck.sql(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("parts", [None, 3])
def test_credit_of_several_curators_and_of_none(spark, parts):
    rows = [(1, "a", "x", "quote"), (1, "a", "y", "link"), (1, "b", "x", "aside"), (2, "a", None, "quote"), (2, "a", "x", "quote"), (3, "c", None, "link"), (None, "d", "x", "quote"), (4, None, "x", "quote"), (1, "a", "x", "link")]
    got = curation.credited(spark.createDataFrame(rows, "p long, who string, c string, k string"), "p", "who", "c", "k", F.lit(1.0), parts)
    assert {tuple(r) for r in got.collect()} == {("a", 2, 2, 3.5938), ("b", 1, 1, 0.25), ("c", 1, 0, 0.5625)}
