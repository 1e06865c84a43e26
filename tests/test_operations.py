"""Windows with parameters, states of services, documents as files, JSON tails, on fixtures with plain loops beside them."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from loomstat.operators import parsing
from loomstat.plans import operations
from loomstat.sources import sinks

DATA = "/root/testdata/sf0.001"
T = datetime(2024, 3, 1)


def test_eight_spans_of_one_text(spark):
    rows = [(T - timedelta(hours=7 * i), "ab"[i % 2], Decimal(i)) for i in range(400)] + [(None, "a", Decimal(9))]
    usage = spark.createDataFrame(rows, "ts timestamp_ntz, api_type string, cost decimal(20,10)")
    spans = {"1h": 3600, "7h": 25_200, "day": 86_400, "2d": 172_800, "week": 604_800, "30d": 2_592_000, "90d": 7_776_000, "year": 31_536_000}
    for as_of in (None, "2024-02-20 00:00:00"):
        end = T if as_of is None else datetime.fromisoformat(as_of)
        want = {}
        for name, seconds in spans.items():
            for ts, api, cost in rows:
                if ts is not None and end - timedelta(seconds=seconds) <= ts <= end:
                    n, c = want.get((name, api), (0, 0.0))
                    want[name, api] = (n + 1, c + float(cost))
        got = {(r["span"], r["api_type"]): (r["n"], r["cost"]) for r in operations.cost_windows(usage, spans, as_of).collect()}
        assert got == want and len(want) > 10


def test_services_in_three_states(spark, tmp_path):
    rows = [
        (1, T, 1, "view", 0), (2, T, 2, "view", 0),  # both up
        (3, T + timedelta(hours=1), 1, "view", 0), (4, T + timedelta(hours=1, minutes=1), 1, "error", 1), (5, T + timedelta(hours=1), 2, "view", 0),
        (6, T + timedelta(hours=2), 1, "error", 5), (7, T + timedelta(hours=2), 2, "error", 5),
        (8, T + timedelta(hours=3), 1, "view", 0),
    ]
    df = spark.createDataFrame([(i, ts, u, kind, 1.0, json.dumps({"k": k})) for i, ts, u, kind, k in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["hour"][-2:]: (r["overall"], r["n"], r["details"]) for r in operations.services_health(spark, str(tmp_path)).collect()}
    assert got == {
        "00": ("healthy", 3, ""),
        "01": ("degraded", 2, "Llama service not available"),
        "02": ("unhealthy", 0, "Llama service not available; OpenRouter service not available"),
        "03": ("degraded", 2, "No refinement service configured"),
    }


def test_documents_parse_again(spark, tmp_path):
    sections = operations.cost_sections(spark, DATA)
    sinks.write_document(str(tmp_path / "d"), sections, spark=spark, rows_a_part=200)
    got = json.loads("".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*"))))
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert list(got) == ["costRecords", "budgetAlerts", "summary", "breakdown", "projections"] and len(got["costRecords"]) == n
    times = [r["timestamp"] for r in got["costRecords"]]
    assert times == sorted(times) and sum(r["count"] for r in got["breakdown"]) == n and set(got["summary"]) == {"daily", "weekly", "monthly"}


def test_json_tails(spark):
    texts = ['{"a": "}\\"}"} rest', '  {"a": {"b": 1}}', '{"output": "own", "x": "{"}', "{broken} rest", "{open", "none", '{"a": "\\\\"} x } y', "", '{"a": 1}' + "}" * 40000]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parsing.json_tail(F.col("t")).alias("x")).orderBy("i").select("x").collect()]
    assert got == ["rest", None, "own", "rest", "{open", "none", "x } y", "", "}" * 40000]


def test_backoff_rules(spark):
    rows = [("rate_limit", 500, 7), ("rate_limit", 429, None), ("rate_limit", 500, 0), ("quota_exceeded", 429, 3), ("network", 429, None), ("api_error", 500, 9)]
    wait, jitter = operations.backoff(F.col("kind"), F.col("status"), F.col("hint"), F.col("status").cast("string"))
    got = spark.createDataFrame(rows, "kind string, status int, hint int").select(wait.alias("w"), jitter.alias("j")).collect()
    assert [r["w"] for r in got] == [7000, 5000, 5000, 60000, 10000, 1000] and all(0 <= r["j"] < 1000 for r in got) and got[0]["j"] == got[2]["j"]


def test_calls_have_a_limit_and_go_side_by_side(spark):
    import time

    from loomstat.operators import providers

    def stuck(prompt):
        import time

        time.sleep(30)

    def slow(prompt):
        import time

        time.sleep(0.3)
        return "a long enough answer"

    df = spark.createDataFrame([(i, "p") for i in range(8)], "id long, prompt string")
    began = time.time()
    got = providers.generate(df, [("stuck", stuck), ("slow", slow)], partitions=2, concurrency=4, retries=1, seconds=1.5).collect()
    assert {(r["status"], r["provider"], r["attempts"]) for r in got} == {("ok", "slow", 2)} and len(got) == 8
    assert time.time() - began < 25
    assert {r["status"] for r in providers.generate(df, [("stuck", stuck)], concurrency=8, retries=1, seconds=0.2).collect()} == {"timeout"}
