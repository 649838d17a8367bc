"""Three-valued filters and what each of them costs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def all_of(filters: Mapping[str, Column | None], without: str | None = None) -> Column:
    """The filters together; None is no filter, an empty list's filter is lit(False)."""
    cond = F.lit(True)
    for name, c in filters.items():
        if c is not None and name != without:
            cond = cond & F.coalesce(c, F.lit(False))
    return cond


def any_in(column: str, values: list | None) -> Column | None:
    """None: no filter; no values: nothing matches."""
    return None if values is None else F.col(column).isin(values) if values else F.lit(False)


def costs(rows: DataFrame, filters: Mapping[str, Column | None]) -> DataFrame:
    """(filter, matched, without): how many rows match, and would match without each filter, in one pass."""
    active = [n for n, c in filters.items() if c is not None]
    one = rows.agg(F.count_if(all_of(filters)).alias("_all"), *(F.count_if(all_of(filters, n)).alias(n) for n in active))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(n).alias("without")) for n in active)))
    return one.select("_all", pairs.alias("p")).select("p.filter", F.col("_all").alias("matched"), "p.without")
