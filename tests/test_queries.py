"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from loomstat.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "events", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, int | float | decimal.Decimal) else str(v)


def rows(cursor_rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr([plain(r[i]) for i in at]) for r in cursor_rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_hourly_sums_to_total(spark):
    hours = registry.QUERIES["hourly_stats"](spark, DATA).collect()
    assert len(hours) == 24
    assert sum(r["generations"] for r in hours) == registry.QUERIES["metrics_summary"](spark, DATA).first()["total"]


def test_health_of_an_empty_window(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    row = registry.QUERIES["health_indicators"](spark, str(tmp_path)).first()
    assert (row["status"], row["success_rate"], row["error_rate"]) == ("healthy", 1, 0)


@pytest.mark.parametrize("name", ["parse_responses", "quality_score", "final_question", "parse_options_section", "request_validation"])
def test_empty_and_null_texts(spark, duck, tmp_path, name):
    texts = [(1, None), (2, ""), (3, "x"), (4, "a. b. c. d. e 12 kg? A) y\n\nB) z"), (4, "a. b. c. d. e 12 kg? A) y\n\nB) z"), (5, "9" * 30 + " m/s and 0.0000001 kg 5.00. 1e5. = equation"), (None, "no id")]
    texts = sorted(set(texts), key=repr) if name == "quality_score" else texts  # its SQL joins by id
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    try:
        got, want = registry.QUERIES[name](spark, str(tmp_path)), duck.sql(registry.ORACLES[name])
        assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
    finally:
        duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
