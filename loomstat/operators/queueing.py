"""Queues and alerts as prefix scans: what depends on the row before is a running maximum or a difference of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trailing import BUCKET_US, micros, ordinal, trailing

#: Places of a chain that are scanned together.
BLOCK = 100_000


def releases(df: DataFrame, *, key: str, ts: str, id_col: str, limit: Column, span_us: int, block: int = BLOCK) -> DataFrame:
    """When a first-come queue lets requests go, ``limit`` of a key at most in any ``span_us``: ``release`` (micros).

    release(i) = max(ts(i), release(i - limit) + span).  Requests whose places are equal modulo the limit form a chain,
    and along a chain release(j) = span * j + max over k <= j of (ts(k) - span * k), a running maximum, which is taken
    in blocks and then over the blocks.  Places are counted in time buckets, so neither step holds a key in one task.

    Rows without key or time are left out; equal times queue by id.  Columns: id, key, ``t``, ``release``.
    """
    own = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(ts).alias("ts"), limit.alias("limit"))
    placed = ordinal(own, key="key", ts="ts", id_col="id", bucket_us=BUCKET_US).withColumn("i", F.col("ordinal") - 1)
    j = F.floor(F.col("i") / F.col("limit"))
    placed = placed.select("id", "key", micros("ts").alias("t"), (F.col("i") % F.col("limit")).alias("chain"), j.alias("j"))
    placed = placed.withColumns({"y": F.col("t") - F.col("j") * span_us, "b": F.floor(F.col("j") / block)})
    tops = placed.groupBy("key", "chain", "b").agg(F.max("y").alias("top"))
    before = Window.partitionBy("key", "chain").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("key", "chain", "b", F.max("top").over(before).alias("carried"))
    inside = Window.partitionBy("key", "chain", "b").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("y", F.max("y").over(inside)).join(tops, ["key", "chain", "b"])
    return out.select(F.col("id").alias(id_col), F.col("key").alias(key), "t", (F.greatest("y", "carried") + F.col("j") * span_us).alias("release"))


def crossings(df: DataFrame, *, key: str, ts: str, id_col: str, span_us: int, more_than: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """``n``, the rows of a key from ``span_us`` before each row on (itself included), and ``fires`` where n first passes ``more_than``.

    A row fires if its count is above and that of the key's row before it was not.  The row before is found in the row's
    time bucket, or is the last one of the bucket before, of which there is a row for each bucket.  Equal times count
    by id.  Rows without key or time are left out.
    """
    own = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(ts).alias("ts"))
    w = trailing(own, key="key", ts="ts", id_col="id", spans={"span": span_us}, bucket_us=bucket_us).select("id", "n_span")
    ties = F.row_number().over(Window.partitionBy("key", "ts").orderBy("id"))
    counted = own.withColumn("ties", ties).join(w, "id").withColumn("n", F.col("n_span") + F.col("ties"))
    counted = counted.withColumn("b", F.floor(micros("ts") / bucket_us))
    lasts = counted.groupBy("key", "b").agg(F.max_by("n", F.struct("ts", "id")).alias("last"))
    lasts = lasts.select("key", "b", F.lag("last").over(Window.partitionBy("key").orderBy("b")).alias("carried"))
    previous = F.lag("n").over(Window.partitionBy("key", "b").orderBy("ts", "id"))
    out = counted.withColumn("previous", previous).join(lasts, ["key", "b"])
    fires = (F.col("n") > more_than) & (F.coalesce("previous", "carried", F.lit(0)) <= more_than)
    return out.select(F.col("id").alias(id_col), F.col("key").alias(key), "n", fires.alias("fires"))


def latest(updates: DataFrame, *, key: str, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Merge on read: of each ``key`` the ``values`` of its last update by ``order``; the log itself is only ever added to.

    Updates are combined before they are shuffled.  Of equal places in the order the greater values count, nulls first.
    """
    top = F.max(F.struct(*order, *values)).alias("top")
    return updates.filter(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, *[F.col(f"top.{v}").alias(v) for v in values])
