"""Retention by age and by number: a mergeable bound on a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, *, n: int, age_seconds: int, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """The newest ``n`` of ``rows`` not older than ``age_seconds`` behind the newest of all.

    Each task keeps ``n`` rows at most before they meet, and the age is cut among those alone: rows beyond it are
    never among newer ones.  Equal times go by the smaller id; equal rows count each; rows without time go.
    """
    first = rows.filter(F.col(ts).isNotNull()).orderBy(F.desc(ts), F.asc(id_col)).limit(n)
    latest = rows.agg(F.max(ts).alias("_latest"))
    kept = first.join(F.broadcast(latest), F.col(ts) >= F.col("_latest") - F.make_dt_interval(secs=F.lit(age_seconds)))
    return kept.drop("_latest")
