"""Named queries as declarative SQL over the tables; Catalyst plans them.

"Now" is the latest event.  Marks (``[[...]]``) stand for what is long to write.  Expected SQL is in ``expected``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dims import CATEGORIES, ERROR_TYPES, LIMITS, METERED, PLACEHOLDER_OPTIONS, RECOVERY, RECOVERY_DEFAULT, TOPICS, values
from ..sources.tables import TABLES, table

_MARKS = {"k": "get_json_object(props, '$.k')", "sec": "unix_seconds_exact"}


def _dialect(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace(f"[[{k}]]", v)
    return sql


HOURS = "VALUES " + ", ".join(f"({h})" for h in range(24))
WITH = {
    "topic_dim": ("ord, topic, display, theme, hl", values([(i, *t) for i, t in enumerate(TOPICS)])),
    "categories": ("theme, category", values(CATEGORIES)),
    "error_types": ("k8, error_type", values(list(enumerate(ERROR_TYPES)))),
    "limits": ("profile, api_type, rpm, rpd, tpm, tpd, token_cost, day_cost", values(LIMITS)),
    "prices": ("api_type, token_cost", values([(a, c) for _, a, _, _, _, _, c, _ in METERED])),
    "recovery": ("error_type, advice", values([(k, "; ".join(v)) for k, v in RECOVERY.items()])),
    "spine": ("h", HOURS),
    "now": ("as_of", "SELECT max(ts) FROM events"),
    "gen_metrics": (
        "id, ts, topic, success, ms",
        "SELECT event_id, ts, topic, event_type <> 'error', CAST(round(value * 200) AS BIGINT) FROM events JOIN topic_dim ON ord = user_id % 29",
    ),
    "error_metrics": (
        "id, ts, topic, error_type",
        "SELECT event_id, ts, topic, error_type FROM events JOIN topic_dim ON ord = user_id % 29"
        " JOIN error_types ON k8 = CAST([[k]] AS BIGINT) % 8 WHERE event_type = 'error'",
    ),
    "usage_records": (
        "id, ts, api_type, operation, tokens, cost",
        "SELECT event_id, ts, api_type, event_type, CAST(round(value * 10) AS BIGINT),"
        " CAST(CAST(round(value * 10) AS BIGINT) * CAST(token_cost AS DECIMAL(10, 7)) AS DECIMAL(20, 10)) FROM events"
        " JOIN prices ON api_type = CASE WHEN user_id % 2 = 0 THEN 'openrouter' ELSE 'huggingface' END",
    ),
}


def _needs(sql: str) -> list[str]:
    """Names of common tables that a text uses, in the order they build on one another."""
    import re

    found: list[str] = []

    def add(text: str) -> None:
        for name in WITH:
            if re.search(rf"\b{name}\b", text) and name not in found:
                add(WITH[name][1])
                found.append(name)

    add(sql)
    return found


def _whole(sql: str) -> str:
    parts = [f"{n}({WITH[n][0]}) AS ({WITH[n][1]})" for n in _needs(sql)]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def _last(interval: str) -> str:
    return f"ts >= (SELECT as_of FROM now) - INTERVAL {interval}"


DAY, QUARTER, HOUR = "'24' HOUR", "'15' MINUTE", "'1' HOUR"
_N = "CAST(count(*) AS BIGINT)"
_RATE = "round(avg(CASE WHEN success THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6)"


# Recommendations and alerts of the texts below, and their thresholds.
def _health(interval: str) -> str:
    return f"""
SELECT status, success_rate, avg_ms, error_rate, quota,
  concat_ws('; ', CASE WHEN success_rate < 0.8 THEN concat('Low success rate: ', CAST(round(success_rate * 100, 1) AS DECIMAL(10, 1)), '%') END,
    CASE WHEN avg_ms > 20000 THEN concat('High response time: ', CAST(round(avg_ms / 1000, 1) AS DECIMAL(10, 1)), 's') END,
    CASE WHEN error_rate > 0.2 THEN concat('High error rate: ', CAST(round(error_rate * 100, 1) AS DECIMAL(10, 1)), '%') END,
    CASE quota WHEN 'critical' THEN 'API quota limits reached' WHEN 'warning' THEN 'API quota usage high' END) AS alerts
FROM (SELECT *, CASE WHEN success_rate < 0.5 OR avg_ms > 30000 OR quota = 'critical' THEN 'critical'
    WHEN success_rate < 0.8 OR avg_ms > 15000 OR error_rate > 0.1 OR quota = 'warning' THEN 'warning' ELSE 'healthy' END AS status
  FROM (SELECT success_rate, avg_ms, CASE WHEN total = 0 THEN 0 ELSE round(CAST(e.n AS DOUBLE) / total, 6) END AS error_rate,
      CASE WHEN e.q > 5 THEN 'critical' WHEN e.q > 2 THEN 'warning' ELSE 'ok' END AS quota
    FROM (SELECT count(*) AS n, count(CASE WHEN error_type = 'api_limit' THEN 1 END) AS q FROM error_metrics WHERE {_last(interval)}) e
      CROSS JOIN (SELECT count(*) AS total, coalesce({_RATE}, 1) AS success_rate, coalesce(round(avg(CASE WHEN success THEN ms END), 6), 0) AS avg_ms FROM gen_metrics WHERE {_last(interval)}) g) a) b"""


SQL: dict[str, str] = {
    "topic_analysis": f"""
SELECT topic, display, coalesce(n, 0) AS attempts, coalesce(rate, 0) AS success_rate, coalesce(avg_ms, 0) AS avg_ms, coalesce(common, '') AS common_errors,
  CASE WHEN coalesce(rate, 0) < 0.7 THEN 'High failure rate - check model training for this topic'
    WHEN coalesce(avg_ms, 0) > 25000 THEN 'Slow generation - consider optimizing prompts'
    WHEN instr(coalesce(common, ''), 'validation_failure') > 0 THEN 'Validation issues - review question format requirements' ELSE 'Performance is good' END AS recommendation
FROM topic_dim LEFT JOIN (SELECT topic AS t, {_N} AS n, {_RATE} AS rate, round(avg(CASE WHEN success THEN ms END), 6) AS avg_ms FROM gen_metrics GROUP BY topic) m ON topic = t
LEFT JOIN (SELECT topic AS t2, concat_ws(',', max(CASE WHEN r = 1 THEN error_type END), max(CASE WHEN r = 2 THEN error_type END), max(CASE WHEN r = 3 THEN error_type END)) AS common
  FROM (SELECT topic, error_type, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first_ts, error_type) AS r
    FROM (SELECT topic, error_type, count(*) AS n, min(ts) AS first_ts FROM error_metrics GROUP BY topic, error_type) x) y WHERE r <= 3 GROUP BY topic) e ON topic = t2""",
    "metrics_summary": f"SELECT {_N} AS total, coalesce({_RATE}, 0) AS success_rate, coalesce(round(avg(CASE WHEN success THEN ms END), 6), 0) AS avg_ms FROM gen_metrics WHERE {_last(DAY)}",
    "errors_by_type": f"SELECT error_type, {_N} AS n FROM error_metrics WHERE {_last(DAY)} GROUP BY error_type",
    "generations_by_topic": f"SELECT topic, {_N} AS n FROM gen_metrics WHERE {_last(DAY)} GROUP BY topic",
    "avg_time_by_topic": f"SELECT topic, round(avg(ms), 6) AS avg_ms FROM gen_metrics WHERE success AND {_last(DAY)} GROUP BY topic",
    "hourly_stats": f"""SELECT lpad(CAST(h AS VARCHAR(2)), 2, '0') AS hour_of_day, coalesce(n, 0) AS generations, coalesce(ok, 0) AS successes, coalesce(avg_ms, 0) AS avg_ms
FROM spine LEFT JOIN (SELECT CAST(hour(ts) AS INT) AS hh, {_N} AS n, CAST(count(CASE WHEN success THEN 1 END) AS BIGINT) AS ok, round(avg(CASE WHEN success THEN ms END), 6) AS avg_ms
  FROM gen_metrics WHERE {_last(DAY)} GROUP BY hour(ts)) g ON h = hh""",
    "health_indicators": _health(QUARTER),
    "health_indicators_24h": _health(DAY),
    "error_patterns": f"SELECT error_type, {_N} AS n, sum(count(*)) OVER () > 10 AS spike FROM error_metrics WHERE {_last(DAY)} GROUP BY error_type HAVING count(*) > 5",
    "error_patterns_10m": f"SELECT error_type, {_N} AS n FROM error_metrics WHERE {_last("'10' MINUTE")} GROUP BY error_type HAVING count(*) > 5",
    "recent_errors_by_type": f"SELECT error_type, {_N} AS n FROM error_metrics WHERE {_last("'5' MINUTE")} GROUP BY error_type",
    "retention_newest_n": "SELECT id, topic, success, ms FROM gen_metrics ORDER BY ts DESC, id LIMIT 1000",
    "cost_by_operation": f"SELECT operation, round(CAST(sum(cost) AS DOUBLE), 8) AS cost, {_N} AS n, round(CAST(sum(cost) AS DOUBLE) / count(*), 10) AS avg_cost FROM usage_records WHERE {_last(DAY)} GROUP BY operation",
    "cost_by_api": f"SELECT api_type, round(CAST(sum(cost) AS DOUBLE), 8) AS cost FROM usage_records WHERE {_last(DAY)} GROUP BY api_type",
    "cost_by_hour": f"SELECT lpad(CAST(hour(ts) AS VARCHAR(2)), 2, '0') AS hour_of_day, round(CAST(sum(cost) AS DOUBLE), 8) AS cost FROM usage_records WHERE {_last(DAY)} GROUP BY hour(ts)",
    "cost_breakdown_rollup": f"SELECT api_type, operation, round(CAST(sum(cost) AS DOUBLE), 8) AS cost, {_N} AS n FROM usage_records GROUP BY ROLLUP (api_type, operation)",
    "daily_cost_by_api": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, api_type, round(CAST(sum(cost) AS DOUBLE), 8) AS cost FROM usage_records GROUP BY CAST(ts AS DATE), api_type",
    "cost_projections": f"SELECT burn AS burn_rate, round(burn * 24, 8) AS daily, round(burn * 168, 8) AS weekly, round(burn * 720, 8) AS monthly FROM (SELECT coalesce(round(CAST(sum(cost) AS DOUBLE), 8), 0) AS burn FROM usage_records WHERE {_last(HOUR)}) x",
    "budget_alerts": f"""SELECT u.api_type, cost, day_cost AS budget, CASE WHEN used >= 1.0 THEN 'exceeded' WHEN used >= 0.9 THEN 'critical' WHEN used >= 0.7 THEN 'warning' ELSE 'ok' END AS alert, round(used, 6) AS used
FROM (SELECT u.*, l.day_cost, CASE WHEN CAST(l.day_cost AS DOUBLE) = 0 THEN NULL ELSE CAST(cost AS DOUBLE) / CAST(l.day_cost AS DOUBLE) END AS used FROM
  (SELECT api_type, round(CAST(sum(cost) AS DOUBLE), 8) AS cost FROM usage_records WHERE {_last(DAY)} GROUP BY api_type) u JOIN limits l ON u.api_type = l.api_type AND l.profile = 'testing') u""",
    "quota_status": f"""SELECT l.api_type, coalesce(n, 0) AS requests_used, rpd AS requests_limit, coalesce(tokens, 0) AS tokens_used, tpd AS tokens_limit, coalesce(cost, 0) AS cost_used, day_cost AS cost_limit, (SELECT as_of FROM now) + INTERVAL '24' HOUR AS reset_at
FROM limits l LEFT JOIN (SELECT api_type, {_N} AS n, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(cost) AS DOUBLE), 8) AS cost FROM usage_records WHERE {_last(DAY)} GROUP BY api_type) u ON l.api_type = u.api_type WHERE profile = 'default'""",
    "usage_stats": f"SELECT api_type, {_N} AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(cost) AS DOUBLE), 8) AS cost, round(CAST(sum(tokens) AS DOUBLE) / count(*), 6) AS avg_tokens FROM usage_records WHERE {_last(DAY)} GROUP BY api_type",
    "usage_hourly_slots": f"""SELECT a.api_type, a.h AS slot, coalesce(n, 0) AS requests FROM (SELECT DISTINCT api_type, h FROM limits JOIN spine ON true) a
LEFT JOIN (SELECT api_type, slot, {_N} AS n FROM (SELECT api_type, 23 - CAST(floor((unix_ - ts_) / 3600.0) AS INT) AS slot FROM (SELECT api_type, [[sec]](ts) AS ts_, [[sec]]((SELECT as_of FROM now)) AS unix_ FROM usage_records WHERE {_last(DAY)}) x) y WHERE slot >= 0 GROUP BY api_type, slot) u ON a.api_type = u.api_type AND a.h = u.slot""",
    "backoff_delay": "SELECT id, h AS attempt, CAST(least(2000 * power(2, h - 1), 30000) AS BIGINT) AS model_ms, CAST(least(1000 * power(2, h - 1), 10000) AS BIGINT) AS refine_ms, CASE h WHEN 1 THEN 1000 WHEN 2 THEN 2000 WHEN 3 THEN 5000 ELSE 10000 END AS table_ms"
    " FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS h FROM events WHERE event_type = 'error') x",
    "affordability": f"SELECT l.api_type, round(CAST(CAST(day_cost AS DECIMAL(12, 4)) - coalesce(cost, 0) AS DOUBLE), 8) AS remaining, CAST('0.01' AS DECIMAL(12, 4)) <= CAST(day_cost AS DECIMAL(12, 4)) - coalesce(cost, 0) AS can_afford FROM limits l LEFT JOIN (SELECT api_type, CAST(sum(cost) AS DECIMAL(20, 10)) AS cost FROM usage_records WHERE {_last(DAY)} GROUP BY api_type) u ON l.api_type = u.api_type WHERE profile = 'testing'",
    "cleanup_counts": f"SELECT 'gen_metrics' AS log, CAST(count(CASE WHEN NOT ({_last("'7' DAY")}) THEN 1 END) AS BIGINT) AS removed, CAST(count(CASE WHEN {_last("'7' DAY")} THEN 1 END) AS BIGINT) AS kept FROM gen_metrics",
    "recovery_suggestions": f"SELECT e.id, e.error_type, coalesce(advice, '{"; ".join(RECOVERY_DEFAULT)}') AS advice FROM error_metrics e LEFT JOIN recovery r ON e.error_type = r.error_type WHERE {_last(DAY)}",
    "topic_catalog": "SELECT event_id AS id, topic, display, coalesce(category, 'Other') AS category, hl FROM events JOIN topic_dim t ON ord = user_id % 29 LEFT JOIN categories c ON t.theme = c.theme",
    "option_topics_filter": "SELECT event_id AS id, topic, CASE WHEN event_id % 2 = 0 THEN 'multiple-choice' ELSE 'long-answer' END AS question_type FROM events JOIN topic_dim ON ord = user_id % 29 WHERE NOT (event_id % 2 = 0 AND theme = 'O')",
    "mask_secret": "SELECT doc_id, CASE WHEN source = '' THEN '' WHEN length(source) <= 4 THEN '****' ELSE concat('****', right(source, 4)) END AS masked FROM documents",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(left(text, 300), '...') ELSE text END AS preview FROM documents",
}

def _spark_sql(sql: str) -> str:
    import re

    text = _dialect(_whole(sql), _MARKS)
    # seconds with their fraction; the tables' timestamps have no zone
    return re.sub(r"unix_seconds_exact\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"(unix_micros(CAST(\1 AS TIMESTAMP)) / 1000000.0)", text)


def _query(name: str):
    text = _spark_sql(SQL[name])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import re

        used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        body = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            body = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}} {t}", body)
        return spark.sql(body, **used)

    return run


QUERIES = {name: _query(name) for name in SQL}
ORACLES: dict[str, str] = {}


def _jsonl_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from ..operators.jsonl import repair

    rows = [(i, t[1]) for i, t in enumerate(TOPICS)]
    names = F.broadcast(spark.createDataFrame(rows, "ord int, name string"))
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").withColumn("ord", (F.col("doc_id") % 29).cast("int")).join(names, "ord")
    row = F.to_json(F.struct(F.lit("Generate").alias("instruction"), F.concat(F.lit("Topic: "), "name").alias("input"), F.col("text").alias("output")))
    lines = docs.select(F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(row).alias("raw"))
    return repair(lines)


def _jsonl_repair_sql() -> str:
    """Expected rows, written from the rule: known topics get a formatted record, what cannot be read stays."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    topics = ", ".join(f"({i}, {quoted(t[1])}, {quoted(t[0])})" for i, t in enumerate(TOPICS))
    options = ", ".join(map(quoted, PLACEHOLDER_OPTIONS))
    head = "'instruction', 'Generate', 'input', 'Topic: ' || name"
    return f"""WITH topics(ord, name, topic) AS (VALUES {topics}),
t AS (SELECT doc_id, text, name, topic FROM documents JOIN topics ON doc_id % 29 = ord)
SELECT doc_id AS line_no, doc_id % 7 <> 0 AND text IS NOT NULL AS repaired, CASE WHEN doc_id % 7 = 0 THEN '{{broken'
  WHEN text IS NULL THEN CAST(json_object({head}) AS VARCHAR)
  ELSE CAST(json_object({head}, 'output', json_object('questionText', text, 'options', [{options}], 'correctAnswer', 'B',
    'topic', topic, 'formatted', true, 'needsGeminiRefinement', true)) AS VARCHAR) END AS line
FROM t"""


QUERIES["jsonl_repair"] = _jsonl_repair
ORACLES["jsonl_repair"] = _jsonl_repair_sql()

from . import expected as _expected  # noqa: E402
from . import operations as _operations  # noqa: E402
from . import questions as _questions  # noqa: E402
from . import records as _records  # noqa: E402
from . import settings as _settings  # noqa: E402

for _module in (_questions, _records, _operations, _settings):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
ORACLES |= _expected.ORACLES
