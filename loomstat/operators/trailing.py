"""Trailing windows as of each row without a sliding frame: differences of running sums.

``n`` and sums over ``[t - span, t)`` are the running sums before ``t`` less those before ``t - span``.  Every row asks
at both places; rows are split by key and time bucket, running sums are taken inside a bucket and buckets are added up
in a small table, so that a hot key spreads over its buckets and each row is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket.
BUCKET_US = 600_000_000


def micros(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing(
    df: DataFrame, *, key: str, ts: str, id_col: str, measures: tuple[str, ...] = (), spans: dict[str, int], bucket_us: int = BUCKET_US
) -> DataFrame:
    """``id_col``, ``key``, and by span ``n_``, ``<measure>_`` (sums) and ``oldest_`` (micros, null where nothing is).

    ``spans`` maps a name to microseconds.  Rows of equal time do not see one another.  Ids must be distinct; null
    measures count as zero; rows without key or time are left out.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(key).alias("key"), micros(ts).alias("t"), *[F.coalesce(m, F.lit(0)).alias(m) for m in measures]
    )
    names = list(spans)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), (F.col("t") - s).alias("x")) for i, s in enumerate([0, *spans.values()])])).alias("p")
    asks = rows.select("id", "key", *measures, at).select("id", "key", "p.kind", "p.x", *[F.when(F.col("p.kind") == 0, F.col(m)).otherwise(0).alias(m) for m in measures])
    asks = asks.withColumns({"n": (F.col("kind") == 0).cast("long"), "b": F.floor(F.col("x") / bucket_us), "own": F.when(F.col("kind") == 0, F.col("x"))})
    sums = ["n", *measures]
    totals = asks.groupBy("key", "b").agg(*[F.sum(c).alias(f"all_{c}") for c in sums], F.min("own").alias("first"))
    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "key", "b", *[F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"base_{c}") for c in sums], F.min("first").over(after).alias("later")
    )
    inside = Window.partitionBy("key", "b").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("key", "b").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asks.select("id", "key", "b", "kind", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in sums], F.min("own").over(ahead).alias("next"))
    seen = seen.join(totals, ["key", "b"]).select(
        "id", "key", "kind", *[(F.col(c) + F.col(f"base_{c}")).alias(c) for c in sums], F.coalesce("next", "later").alias("next")
    )
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = seen.groupBy("id", "key").agg(
        *[(pick(c, 0) - pick(c, i + 1)).alias(f"{c}_{name}") for i, name in enumerate(names) for c in sums],
        *[pick("next", i + 1).alias(f"next_{name}") for i, name in enumerate(names)],
    )
    oldest = [F.when(F.col(f"n_{name}") > 0, F.col(f"next_{name}")).alias(f"oldest_{name}") for name in names]
    return out.select(F.col("id").alias(id_col), F.col("key").alias(key), *[f"{c}_{name}" for name in names for c in sums], *oldest)


def ordinal(df: DataFrame, *, key: str, ts: str, id_col: str, bucket_us: int = 86_400_000_000) -> DataFrame:
    """``df`` with ``ordinal``: the place of a row in its key by time and id, from 1, counted bucket by bucket."""
    own = df.withColumn("b", F.floor(micros(ts) / bucket_us))
    sizes = own.groupBy(key, "b").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "b", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(key, "b").orderBy(ts, id_col)
    numbered = own.withColumn("at", F.row_number().over(inside))
    return numbered.join(sizes, [key, "b"]).select(*df.columns, (F.col("at") + F.col("base")).alias("ordinal"))
