"""Every registered query against its SQL, as values."""

import duckdb
import pandas as pd
import pytest

from marginalia.plans import registry

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shape(frame):
    """Rows as sorted tuples of strings, columns by name."""
    frame = frame[sorted(frame.columns)]
    def one(v):
        if pd.isna(v):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return f"{float(v):.4f}"
        return str(v)[:10] if hasattr(v, "year") and not hasattr(v, "hour") else str(v)
    return list(frame.columns), sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, D)
    got = got.withColumns({c: got[c].cast("string") for c, t in got.dtypes if t in ("date",)}).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    for c in want.columns:
        if str(want[c].dtype).startswith("datetime") and not str(got[c].dtype).startswith("datetime"):
            want[c] = want[c].dt.strftime("%Y-%m-%d")
    assert shape(got) == shape(want)


def test_components(spark):
    from marginalia.operators.graph import connected_components

    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (None, 1), (6, 5), (9, 6), (9, 10)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 5, 10: 5}
    assert connected_components(edges.limit(0)).count() == 0
