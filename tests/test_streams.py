"""Streams over several micro-batches against batch queries and plain loops; versioned tables between any two steps."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomstat.operators import queueing, trailing
from loomstat.operators.newest import newest
from loomstat.sources import sinks
from loomstat.sources.snapshots import Conflict, Snapshots
from loomstat.streaming import streams

USAGE = "id long, api_type string, us long, tokens long, cost long"
LIMITS = {a: {"rpm": 3, "rpd": 40, "tpm": 250, "tpd": 3000, "day_cost": 2500} for a in "ab"}
T = datetime(2024, 1, 1)


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream of one file for each list of rows, one file a micro-batch."""

    def make(batches, schema):
        path = tmp_path / "in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"b={i:03d}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(path) + "/*")

    return make


def drain(df, name, checkpoint=None):
    w = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination(300)
    return q, df.sparkSession.table(name).collect()


def requests(n, steps):
    rnd, us, rows = random.Random(1), 86_400_000_000 * 19_000, []
    for i in range(n):
        us += rnd.choice(steps)
        rows.append((i, rnd.choice("ab"), us, rnd.randint(0, 150), rnd.randint(0, 90)))
    return rows


def naive_decisions(rows):
    out = {}
    for rid, api, us, *_ in rows:
        own = [x for x in rows if x[1] == api and x[2] < us]
        day, minute = [[x for x in own if x[2] >= us - span] for span in (86_400_000_000, 60_000_000)]
        lim = LIMITS[api]
        tokens = lambda xs: sum(x[3] for x in xs)
        said = (
            "reject_cost" if sum(x[4] for x in day) >= lim["day_cost"] else "reject_requests" if len(day) >= lim["rpd"] else "reject_tokens" if tokens(day) >= lim["tpd"]
            else "delay" if len(minute) >= lim["rpm"] else "delay_tokens" if tokens(minute) >= lim["tpm"] else "admit"
        )
        wait = 60_000 - (us - min(x[2] for x in minute)) // 1000 if said.startswith("delay") else 0
        out[rid] = (said, wait)
    return out


def test_admission_over_micro_batches(stream_of, spark):
    rows = requests(500, [0, 1_000_000, 9_000_000, 40_000_000, 900_000_000, 3_000_000_000])
    src = stream_of([rows[i : i + 90] for i in range(0, 500, 90)], USAGE)
    _, got = drain(streams.admission(src, LIMITS), "admitted")
    want = naive_decisions(rows)
    assert {r["id"]: (r["decision"], r["wait_ms"]) for r in got} == want and len({d for d, _ in want.values()}) >= 5
    df = spark.createDataFrame(rows, USAGE).withColumn("ts", F.timestamp_micros("us"))
    w = trailing.trailing(df, key="api_type", ts="ts", id_col="id", measures=("tokens", "cost"), spans={"m": 60_000_000, "d": 86_400_000_000}, bucket_us=7_000_000)
    for r in w.collect():
        own = [x for x in rows if x[1] == r["api_type"] and x[2] < rows[r["id"]][2]]
        day, minute = [[x for x in own if x[2] >= rows[r["id"]][2] - span] for span in (86_400_000_000, 60_000_000)]
        assert (r["n_d"], r["n_m"], r["tokens_d"], r["cost_d"], r["oldest_m"]) == (len(day), len(minute), sum(x[3] for x in day), sum(x[4] for x in day), min((x[2] for x in minute), default=None))


def test_admission_state_goes_after_a_day(stream_of, spark, tmp_path):
    day = 86_400_000_000
    batches = [[(10 * d + i, "a", d * day + i * 1_000_000, 1, 1) for i in range(5)] for d in range(19_000, 19_006)]
    _, got = drain(streams.admission(stream_of(batches, USAGE), LIMITS), "expiring", str(tmp_path / "c"))
    assert len(got) == 30
    state = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "rows").load(str(tmp_path / "c"))
    assert state.select("key.bucket").distinct().count() <= 3


def test_quota_fixture(stream_of):
    """The sixth call in a minute is delayed, not rejected; after fifty calls in a day the next one is rejected."""
    start = 86_400_000_000 * 19_000
    rows = [(i, "x", start + i * 1_000_000, 1, 0) for i in range(6)] + [(i, "y", start + i * 60_000_001, 1, 0) for i in range(100, 152)]
    limits = {"rpm": 5, "rpd": 50, "tpm": 10_000, "tpd": 100_000, "day_cost": 1}
    _, out = drain(streams.admission(stream_of([rows], USAGE), {"x": limits, "y": limits}), "quota")
    got = {r["id"]: (r["decision"], r["wait_ms"]) for r in out}
    assert got[5] == ("delay", 55_000) and got[4][0] == "admit" and got[149][0] == "admit" and got[150][0] == "reject_requests"


def test_alerts_fire_once(stream_of, spark):
    rnd, us, rows = random.Random(4), 1_700_000_000_000_000, []
    for i in range(300):
        us += rnd.choice([0, 20_000_000, 60_000_000, 200_000_000, 900_000_000])
        rows.append((i, rnd.choice("aab"), us))
    want = {}
    for key in "ab":
        above = False
        own = [r for r in rows if r[1] == key]
        for k, (rid, _, us) in enumerate(own):
            n = sum(r[2] >= us - 600_000_000 for r in own[: k + 1])
            if n > 5 and not above:
                want[rid] = n
            above = n > 5
    _, got = drain(streams.error_alerts(stream_of([rows[i : i + 70] for i in range(0, 300, 70)], "id long, error_type string, us long")), "alerts")
    assert {r["id"]: r["n"] for r in got} == want and len(want) > 5
    df = spark.createDataFrame(rows, "id long, error_type string, us long").withColumn("ts", F.timestamp_micros("us"))
    batch = queueing.crossings(df, key="error_type", ts="ts", id_col="id", span_us=600_000_000, more_than=5, bucket_us=100_000_000)
    assert {r["id"]: r["n"] for r in batch.filter("fires").collect()} == want


def test_releases(spark):
    rnd, t, rows = random.Random(2), 0, []
    for i in range(400):
        t += rnd.choice([0, 0, 5, 30, 300])
        rows.append((i, rnd.choice("ab"), T + timedelta(seconds=t)))
    rows += [(1000, None, T), (1001, "a", None)]
    for limit, block in ((1, 7), (3, 100_000)):
        got = queueing.releases(spark.createDataFrame(rows, "id long, k string, ts timestamp"), key="k", ts="ts", id_col="id", limit=F.lit(limit), span_us=60_000_000, block=block)
        want = {}
        for key in "ab":
            out = []
            for rid, _, ts in sorted((r for r in rows if r[1] == key and r[2]), key=lambda r: (r[2], r[0])):
                us = (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)
                out.append(max(us, out[-limit] + 60_000_000) if len(out) >= limit else us)
                want[rid] = out[-1]
        assert {r["id"]: r["release"] for r in got.collect()} == want


def test_retention(stream_of, spark, tmp_path):
    """More rows live than may stay, over micro-batches with late rows; equal to the batch form, a replay changes nothing."""
    rows = [(i, T + timedelta(minutes=(7 * i) % 3000), f"r{i}") for i in range(600)]
    schema = "id long, ts timestamp, note string"
    src = stream_of([rows[i : i + 130] for i in range(0, 600, 130)], schema)
    sink = sinks.retention_sink(str(tmp_path / "kept"), n=100, age_seconds=24 * 3600)
    src.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(300)
    want = sorted(tuple(r) for r in newest(spark.createDataFrame(rows, schema), n=100, age_seconds=24 * 3600).collect())
    latest = max(r[1] for r in rows)
    live = sorted((r for r in rows if r[1] >= latest - timedelta(days=1)), key=lambda r: (-r[1].timestamp(), r[0]))
    assert len(live) > 100 and want == sorted(live[:100])
    table = Snapshots(spark, str(tmp_path / "kept"))
    assert sorted(tuple(r) for r in table.read().collect()) == want
    before = table.versions()
    sink(spark.createDataFrame([(9999, T + timedelta(days=9), "again")], schema), 4)
    assert table.versions() == before
    few = newest(spark.createDataFrame([(1, T, ""), (2, T - timedelta(days=2), ""), (3, None, "")], schema), n=5, age_seconds=3600)
    assert [r["id"] for r in few.collect()] == [1]


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_log_sink_replay_and_days(spark, tmp_path, form):
    schema = "id long, ts timestamp"
    sink = sinks.log_sink(str(tmp_path / "log"), days=7, form=form)
    batches = [[(10 * b + i, T + timedelta(days=3 * b, hours=5 * i)) for i in range(10)] for b in range(5)]
    for b, rows in enumerate(batches):
        for _ in range(2):  # each batch comes twice
            sink(spark.createDataFrame(rows, schema), b)
    got = spark.read.schema(schema + ", day date, batch int").format(form).load(str(tmp_path / "log")).collect()
    newest_day = max(r[1] for rows in batches for r in rows).date()
    want = sorted(r[0] for rows in batches for r in rows if r[1].date() >= newest_day - timedelta(days=7))
    assert sorted(r["id"] for r in got) == want and len(want) < 50


def test_snapshots_between_any_two_steps(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    assert t.read() is None and t.reset() is None
    t.commit(spark.range(3).toDF("x"))
    assert t.read().count() == 3
    prepared = t.prepare(t.read().selectExpr("x + 10 AS x"))  # a rewrite that reads itself
    assert t.read().agg({"x": "max"}).first()[0] == 2  # written, not yet live
    other = Snapshots(spark, str(tmp_path / "t"))
    other.commit(spark.range(5).toDF("x"), base=1)
    with pytest.raises(Conflict):
        t.publish(prepared, base=1)
    assert other.read().count() == 5
    held = t.read()  # a reader that began before a reset reads on
    t.reset()
    assert t.read().count() == 0 and held.count() == 5 and t.read(1).count() == 3
    t.commit(spark.range(2).toDF("x"))
    t.vacuum(1)
    assert t.read().count() == 2 and t.versions() == [4] and t.read(1) is None
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 1


def test_document_in_parts(spark, tmp_path):
    rows = spark.range(57).selectExpr("id", "concat('say \"', id, '\"') AS note", "IF(id = 5, NULL, id / 4) AS v", "lpad(id, 6, '0') AS _order")
    sections = {"records": rows, "summary": '{"total":57}', "alerts": rows.limit(0), "last": rows.filter("id = 7")}
    sinks.write_document(str(tmp_path / "d"), sections, spark=spark, rows_a_part=10)
    parts = sorted((tmp_path / "d").glob("part-*"))
    got = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 3 and list(got) == list(sections)
    assert [r["id"] for r in got["records"]] == list(range(57)) and got["records"][5] == {"id": 5, "note": 'say "5"', "v": None}
    assert got["summary"] == {"total": 57} and got["alerts"] == [] and len(got["last"]) == 1


def test_latest_update_wins(spark):
    rows = [(1, True, 5, 1), (1, False, 5, 2), (2, True, 9, 3), (2, False, 3, 4), (None, True, 1, 5), (3, True, 1, 6), (3, True, 1, 6)]
    got = queueing.latest(spark.createDataFrame(rows, "error_id long, resolved boolean, at long, update_id long"), key="error_id", order=("at", "update_id"), values=("resolved",))
    assert {r["error_id"]: r["resolved"] for r in got.collect()} == {1: False, 2: True, 3: True}
