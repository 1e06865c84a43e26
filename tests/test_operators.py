import json

import pytest

from loomstat.operators.jsonl import repair
from loomstat.operators import parsing, providers, records, validation
from loomstat.sources import tables
from loomstat.streaming import streams


def test_jsonl_repair_keeps_lines(spark):
    good = json.dumps({"instruction": "Generate", "input": "Topic: Gas Laws", "output": "What is p?"})
    raw = [good, "{broken", json.dumps({"instruction": "x", "input": "no topic", "output": "y"}), json.dumps({"instruction": "x", "input": "Topic: Nope", "output": "y"})]
    out = repair(spark.createDataFrame(list(enumerate(raw)), "line_no long, raw string")).orderBy("line_no").collect()
    assert [r["repaired"] for r in out] == [True, False, False, False]
    assert [r["line"] for r in out[1:]] == raw[1:]
    assert json.loads(out[0]["line"])["output"]["topic"] == "gas-laws"
    assert json.loads(out[0]["line"])["output"]["options"][0] == "A) 10 m/s"


def test_settings_defaults(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": "1", "b": ""}')
    row = tables.read_settings(spark, str(tmp_path / "s.json"), {"a": "x", "b": "y", "c": "z"}).first()
    assert tuple(row) == ("1", "y", "z")


def test_csv_escapes_quotes(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, 'say "hi"')], "id int, note string"), str(tmp_path / "o"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")).first()["note"] == 'say "hi"'


@pytest.fixture
def stream_of(spark, tmp_path):
    def make(rows, schema):
        path = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    return make


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_sliding_summary_equals_batch(stream_of, spark):
    from datetime import datetime, timedelta

    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), i % 3 > 0, 100 * i) for i in range(10)]
    src = stream_of(rows, "ts timestamp, success boolean, processing_ms long")
    got = drain(streams.sliding_summary(src, "4 hours", "2 hours"), "sliding", "complete")
    batch = streams.sliding_summary(spark.createDataFrame(rows, "ts timestamp, success boolean, processing_ms long"), "4 hours", "2 hours").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


# --- parsing and validation: inputs and results as the reference's own tests have them ----------------------------


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    return [r["x"] for r in df.select("i", parsing.parse(df.response).alias("x")).orderBy("i").collect()]


GOOD = "QUESTION: What is the velocity of an object?\nA) 5.0 m/s\nB) 10.0 m/s\nC) 15.0 m/s\nD) 20.0 m/s\n\nANSWER: B"


def test_parse_fixtures(spark):
    two = "QUESTION: What is the velocity of it?\nA) 5 m/s\nB) 10 m/s\nANSWER: A"
    blank = "QUESTION: What is the velocity of it?\nA) 5 m/s\nB) 10 m/s\nC)\nD) 20 m/s\nANSWER: A"
    good, bare, few, no_answer, hole, poor, wrapped, none, empty = parsed(
        spark,
        GOOD,
        GOOD.replace("QUESTION: ", ""),
        two,
        GOOD.replace("\n\nANSWER: B", ""),
        blank,
        "QUESTION: What is this thing\nA) x\nB) x\nC) z\nD) w\nANSWER: B",
        json.dumps({"response": '{"input":"x","output":""}' + GOOD}).replace('": "', '":"'),
        None,
        "",
    )
    assert good["success"] and good["answer"] == "B" and good["confidence"] > 0.5
    assert good["options"] == ["A) 5.0 m/s", "B) 10.0 m/s", "C) 15.0 m/s", "D) 20.0 m/s"] == bare["options"] == wrapped["options"]
    assert bare["success"] and bare["question_text"] == good["question_text"] == wrapped["question_text"]
    assert not few["success"] and few["error"] == "Expected 4 options, found 0" == hole["error"]
    assert no_answer["success"] and no_answer["answer"] == "A"
    assert good["confidence"] > poor["confidence"]
    assert none["error"] == empty["error"] == "No question text found"


def test_parse_stats_fixture(spark):
    df = spark.createDataFrame([(GOOD,), (GOOD,), ("nothing",), ("QUESTION: only a question here?",)], "response string")
    r = parsing.parse_stats(df).first()
    assert (r["total"], r["successes"]) == (4, 2) and r["avg_confidence"] > 0 and len(r["common_errors"]) >= 1
    assert parsing.parse_stats(df.limit(0)).first()["total"] == 0


def test_error_messages_fixture(spark):
    df = spark.createDataFrame([("Error: no model",), ("I cannot do that",), ("Unable to reach it",), ("failed to load",), ("fine",), (None,)], "t string")
    assert [r[0] for r in df.select(parsing.error_message(df.t)).collect()] == ["no model", "do that", "reach it", "load", None, None]


def judged(spark, text, options=("A) 1 m", "B) 2 m", "C) 3 m", "D) 4 m"), answer="B", topic="kinematics"):
    df = spark.createDataFrame([(1, topic, text, None if options is None else list(options), answer)], "id long, topic string, question_text string, options array<string>, answer string")
    return validation.validate(df).first()


def test_validation_fixtures(spark):
    text = "A car accelerates from rest at 2 m/s² for 5 s. What is its final velocity?"
    good = judged(spark, text, ["A) 5 m/s", "B) 10 m/s", "C) 15 m/s", "D) 20 m/s"])
    assert good["f"]["is_valid"] and good["f"]["option_count"] == 4
    empty = judged(spark, "")
    assert not empty["f"]["is_valid"] and len(empty["f"]["errors"]) == 1
    few = judged(spark, text, ["A) 5 m/s", "B) 10 m/s"])
    assert not few["f"]["is_valid"] and few["f"]["option_count"] == 2
    assert any("A, B, C, or D" in e["message"] for e in judged(spark, text, answer="E")["f"]["errors"])
    assert good["p"]["accuracy"] == "accurate" and good["p"]["unit_consistency"] and good["v"]["acceptable"]
    fast = judged(spark, "A particle moves at 500000000 m/s for a time of 2 s. What is its velocity?")
    assert fast["p"]["accuracy"] == "major-errors" and any("exceeds speed of light" in e["message"] for e in fast["p"]["errors"]) and not fast["v"]["acceptable"]
    off = judged(spark, "What is the color of the sky on a sunny day in summer?")
    assert off["c"]["relevance"] < 0.3 and any("relevant" in w["message"] for w in off["c"]["warnings"])
    assert judged(spark, None, None, None)["f"]["option_count"] == 0


def test_retry_after_and_records(spark):
    df = spark.createDataFrame([(1, "kinematics"), (2, "kinematics"), (3, "fission")], "id long, topic string")
    got = {r["id"]: r["question_text"] for r in records.pick_fallback(df).collect()}
    assert got[1].startswith("An object") and got[2].startswith("A car") and "fallback question for fission" in got[3]


def test_providers(spark):
    def slow(prompt):
        raise TimeoutError

    def broken(prompt):
        raise ValueError("unauthorized")

    df = spark.createDataFrame([(i, json.dumps({"input": f"Topic: T{i}"}) if i else None) for i in range(7)], "id long, prompt string")
    got = {r["id"]: r for r in providers.generate(df, [("slow", slow), ("broken", broken), ("offline", providers.offline)], retries=2).collect()}
    assert got[0]["status"] == "error" and got[1]["provider"] == "offline" and got[1]["attempts"] == 4 and "T1" in got[1]["response"]
    assert providers.generate(df, [("slow", slow)], keep_failures=False).count() == 0
    assert {r["status"] for r in providers.generate(df.filter("id > 0"), [("slow", slow)]).collect()} == {"timeout"}


def test_sources(spark, tmp_path, monkeypatch):
    lines = [f"line {i}" for i in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    df = tables.read_lines(spark, str(tmp_path / "a.txt"))
    assert [r["raw"] for r in df.orderBy("line_no").collect()] == lines and {r["line_no"] for r in df.collect()} == set(range(500))
    tables.write_texts(df.orderBy("line_no"), str(tmp_path / "t"), "raw")
    again = spark.read.text(str(tmp_path / "t"))
    assert again.count() == 500
    (tmp_path / "s.json").write_text('{"a": "1", "b": ""}')
    monkeypatch.setenv("LOOM_B", "7")
    assert tables.read_config(spark, str(tmp_path / "s.json"), {"b": "LOOM_B", "a": "LOOM_A"}, {"a": "x", "b": "y", "c": "z"}) == {"a": "1", "b": "7", "c": "z"}
    (tmp_path / "audit.json").write_text('{"results": [{"path": "/", "theme": "dark", "offenders": [{"ratio": 2.5}, {"ratio": 4.0}]}]}')
    assert sorted(r["ratio"] for r in tables.read_audit(spark, str(tmp_path / "audit.json")).collect()) == [2.5, 4.0]
    tables.write_settings(spark.createDataFrame([("1",)], "a string"), str(tmp_path / "w"))
    assert tables.read_settings(spark, str(tmp_path / "w"), {"a": "x", "b": "y"}).first()["b"] == "y"
