"""Cohort retention: salted subgroups of clicks meet the starts of their clients in cogrouped Arrow batches.

A state is what was known at a cutoff.  Clients with many clicks are dealt over several salts; their starts and
segments are replicated to each salt.  A bin holds the subgroups that hash to it and is one cogroup, so that numpy
works on many clients at once and no bin grows with a client.  A second reduction brings a client's salts together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, store

#: Bins for each shuffle partition at least, clicks of a bin on average at most, and clicks of a salt at least.
BINS_A_PARTITION, BIN_ROWS, LEAST_ROWS = 8, 200_000, 1_000
DAY = 86_400_000_000
#: Cutoff of the query's first state; its second state knows every click.
CUTOFF = "2024-02-15 00:00:00"


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.timestamp("us", column.type.tz)).cast("int64").fill_null(0).to_numpy()


def _cells(n_states: int, cohort_days: int, period_days: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums of each client's clicks by state and period in one bin."""
    schema = pa.schema(
        [("state", "int32"), ("segment", "string"), ("cohort", "int64"), ("period", "int64"), ("client", "int64"), ("moved", "int32"), ("cents", "int64")]
    )

    def run(clicks: pa.Table, starts: pa.Table) -> pa.Table:
        clients, at = np.unique(starts["client"].to_numpy(), return_index=True)  # salts of a client may share a bin
        if not len(clients) or not clicks.num_rows:
            return schema.empty_table()
        segments = starts["segment"].take(pa.array(at))
        own = clicks["client"].to_numpy()
        row = np.minimum(np.searchsorted(clients, own), len(clients) - 1)
        found = clients[row] == own
        ts, known, cents = _micros(clicks["ts"]), clicks["known"].to_numpy(), clicks["cents"].to_numpy()
        begun, start = [], []
        for j in range(n_states):
            column = starts[f"start{j}"].take(pa.array(at))
            begun.append(~np.asarray(column.is_null()))
            start.append(_micros(column))
        cohort = [s // (cohort_days * DAY) for s in start]
        moved = (begun[0] & begun[-1] & (cohort[0] != cohort[-1])).astype("i4")
        out = []
        for j in range(n_states):
            some = np.flatnonzero(found & begun[j][row] & (known <= j) & (ts >= start[j][row]))
            if not len(some):
                continue
            who = row[some]
            period = (ts[some] - start[j][who]) // (period_days * DAY)
            order = np.lexsort((period, who))
            who, period = who[order], period[order]
            first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (period[1:] != period[:-1])])
            sums = np.add.reduceat(cents[some][order], first)
            who = who[first]
            cols = [np.full(len(first), j, "i4"), segments.take(pa.array(who)).combine_chunks(), cohort[j][who], period[first], clients[who], moved[who], sums]
            out.append(pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def retention(
    clicks: DataFrame,
    clients: DataFrame,
    *,
    arrived: Column | None = None,
    cutoffs: Sequence[str | None] = (None,),
    start_kind: str = "signup",
    cohort_days: int = 1,
    period_days: int = 1,
    bin_rows: int = BIN_ROWS,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``state``, ``segment``, ``cohort``, ``period``, ``users``, ``users_crc32``, ``moved``, ``cents`` of each nonempty cell.

    State j knows the clicks with ``arrived`` (else ``arrived_at``) before ``cutoffs[j]`` (ascending; None: all of them).  In
    each state a client starts at its earliest known click of ``start_kind`` and is counted from then on, in cohorts
    and periods of so many days.  ``moved`` users have starts of different cohorts in the first and the last state.

    Equal rows (all columns) count once.  Rows without ``ts`` or ``client_id`` are dropped; a click that never arrived
    is known where the cutoff is None alone; null and NaN values are 0 cents, infinite ones the largest long.  Of
    several rows of a client the smallest segment counts; null or missing segments are ''.  Ties of starts need no
    order.  Empty tables give an empty result; other columns tell rows apart and are not read otherwise.
    """
    spark = clicks.sparkSession
    came = F.col("arrived_at") if arrived is None else arrived
    last = len(cutoffs) - 1
    known = F.lit(last)
    for j in reversed(range(len(cutoffs))):
        before = F.lit(True) if cutoffs[j] is None else F.coalesce(came < F.lit(cutoffs[j]).cast("timestamp_ntz"), F.lit(False))
        known = F.when(before, j).otherwise(known if cutoffs[last] is None or j < last else F.lit(last + 1))
    rest = [c for c in clicks.columns if c not in ("ts", "client_id", "kind", "value", "click_id")]
    told = [x for c in rest for x in (F.col(c), F.col(c).isNull())]  # a null alone leaves no trace in a hash
    rows = clicks.filter("ts IS NOT NULL AND client_id IS NOT NULL").select(
        F.col("client_id").cast("long").alias("client"),
        "ts",
        "kind",
        "value",
        "click_id",
        known.alias("known"),
        F.xxhash64(F.lit(1), *told).alias("h1"),
        F.xxhash64(F.lit(2), *told).alias("h2"),
    )
    rows = store(
        rows.distinct()
        .filter(F.col("known") <= last)
        .select(
            "client",
            "ts",
            "known",
            (F.col("kind") == start_kind).alias("begins"),
            F.coalesce(F.floor(F.col("value") * 100 + 0.5), F.lit(0)).cast("long").alias("cents"),
            F.xxhash64("click_id", "ts").alias("h"),
        )
    )
    least = [F.min(F.when(F.col("begins") & (F.col("known") <= j), F.col("ts"))).alias(f"start{j}") for j in range(len(cutoffs))]
    starts = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n"), *least).filter(f"start{last} IS NOT NULL")
    segments = clients.filter("client_id IS NOT NULL").groupBy(F.col("client_id").cast("long").alias("client")).agg(F.min("segment").alias("segment"))
    starts = store(starts.join(segments, "client", "left").withColumn("segment", F.coalesce("segment", F.lit(""))))

    n = rows.count()
    bins = max(BINS_A_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), -(-n // bin_rows))
    limit = max(least_rows, -(-n // bins))
    # A table of its own: Spark sends it where its size is under the broadcast threshold, else it splits the skewed join.
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = store(starts.filter(F.col("n") > limit).select("client", salts.alias("salts")))
    bin_of = lambda salt: F.pmod(F.xxhash64("client", salt), F.lit(bins)).cast("int").alias("bin")
    salt = F.coalesce(F.pmod(F.col("h"), F.col("salts")), F.lit(0)).cast("int")
    dealt = rows.join(hot, "client", "left").select(bin_of(salt), "client", "ts", "known", "cents")
    copies = starts.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    copies = copies.select(bin_of(F.col("salt")), "client", "segment", *[f"start{j}" for j in range(len(cutoffs))])
    cells = dealt.groupBy("bin").cogroup(copies.groupBy("bin")).applyInArrow(
        _cells(len(cutoffs), cohort_days, period_days), "state int, segment string, cohort long, period long, client long, moved int, cents long"
    )
    cell = ["state", "segment", "cohort", "period"]
    users = cells.groupBy(*cell, "client").agg(F.max("moved").alias("moved"), F.sum("cents").alias("cents"))
    return users.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("users"),
        F.sum(F.crc32(F.col("client").cast("string").cast("binary"))).alias("users_crc32"),
        F.sum("moved").cast("long").alias("moved"),
        F.sum("cents").alias("cents"),
    )


def op11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`retention` of ``clicks`` by day, known before the cutoff and now; clicks with 3 | crc32(id) come crc32 mod 100 days later.

    Null click ids are not late; nulls, ties, repeated rows and empty tables as told there.
    """
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(h % 3 == 0, h % 100).otherwise(0)
    arrived = F.col("arrived_at") + F.make_dt_interval(late.cast("int"))
    return retention(read(spark, sf_dir, "clicks"), read(spark, sf_dir, "clients"), arrived=arrived, cutoffs=(CUTOFF, None))


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text in SQL; ``tab`` is its table."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
e AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT e.*, {_crc32("click_id::VARCHAR")} AS h FROM e, t),
c AS (SELECT client_id, ts, kind, CASE WHEN value IS NULL THEN 0 ELSE floor(100 * value + 0.5)::BIGINT END AS cents,
  coalesce(arrived_at + to_days(CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END::INTEGER) < TIMESTAMP '{CUTOFF}', false) AS early FROM h),
k AS (SELECT s.state, c.* FROM c, (VALUES (0), (1)) s(state) WHERE s.state = 1 OR early),
b AS (SELECT state, client_id, min(ts) AS start FROM k WHERE kind = 'signup' GROUP BY ALL),
d AS (SELECT *, date_diff('day', DATE '1970-01-01', start::DATE) AS cohort FROM b),
m AS (SELECT client_id FROM d GROUP BY 1 HAVING count(DISTINCT cohort) > 1),
u AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY 1),
p AS (SELECT k.state, k.client_id, d.cohort, (epoch_us(k.ts) - epoch_us(d.start)) // 86400000000 AS period, sum(cents) AS cents
  FROM k JOIN d USING (state, client_id) WHERE k.ts >= d.start GROUP BY ALL),
r AS (SELECT DISTINCT client_id FROM d),
x AS (SELECT client_id, {_crc32("client_id::VARCHAR")} AS crc FROM r, t)
SELECT p.state::INTEGER AS state, coalesce(u.segment, '') AS segment, p.cohort::BIGINT AS cohort, p.period::BIGINT AS period, count(*)::BIGINT AS users,
  sum(x.crc)::BIGINT AS users_crc32, count(m.client_id)::BIGINT AS moved, sum(p.cents)::BIGINT AS cents
FROM p JOIN x USING (client_id) LEFT JOIN u USING (client_id) LEFT JOIN m USING (client_id) GROUP BY 1, 2, 3, 4
"""
QUERIES = {"op11_retention": op11_retention}
ORACLES = {"op11_retention": ORACLE}
