"""Operations on the logs: queues, alerts, backoff, resolutions, cost windows, exports and statistics of services.

Expected SQL is written apart from the operators, from the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strings
from ..functions.dims import ENVIRONMENTS, MODEL_SETTINGS
from ..operators import queueing, records, trailing
from ..sources import sinks
from ..sources.tables import table
from .records import _ERRORS_SQL, _EVENTS_SQL, _US, USAGE_SQL, _errors, _topics_of_events, _usage

#: A queue lets ``rpm`` requests of an API go in so many seconds.
QUEUE_SECONDS = 600
#: Errors of a type in so many seconds that raise an alert when they are passed.
ALERT_SECONDS, ALERT_MORE = 21_600, 2
#: Waits by kind of error in ms (a server's hint in seconds goes first), and the bound of the jitter.
WAITS = {"rate_limit": 5000, "quota_exceeded": 60000, "429": 10000, "other": 1000}
JITTER_MS = 1000
#: Errors of a service on a day that show it up at all.
SERVICES = {"llama": "llama%", "openrouter": "openrouter%"}


def _hash(text: Column, bound: int) -> Column:
    """A number below ``bound`` that follows from a text alone."""
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % bound


_HASH_SQL = "(('0x' || substr(md5({}), 1, 8))::BIGINT % {})".format


# --- queues, alerts, backoff ------------------------------------------------------------------------------------


def delay_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a first-come queue of each API lets its requests go, and how long they wait."""
    u = _usage(spark, sf_dir)
    r = queueing.releases(u, key="api_type", ts="ts", id_col="id", limit=F.col("rpm"), span_us=QUEUE_SECONDS * _US)
    return r.select("id", "api_type", F.col("release").alias("release_us"), F.floor((F.col("release") - F.col("t")) / 1000).alias("wait_ms"))


def rate_limit_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a request waits until the oldest of the last minute's requests leaves a minute that is full."""
    u = _usage(spark, sf_dir)
    span = 60 * _US
    w = trailing.trailing(u, key="api_type", ts="ts", id_col="id", spans={"span": span}).join(u.select("id", "rpm", trailing.micros("ts").alias("t")), "id")
    wait = F.lit(60_000) - F.floor((F.col("t") - F.col("oldest_span")) / 1000)
    return w.select("id", "api_type", F.col("n_span").alias("n"), F.when(F.col("n_span") >= F.col("rpm"), wait).otherwise(0).cast("long").alias("wait_ms"))


def error_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with their type's count of the last hours, and whether the alert of the type fires at them."""
    c = queueing.crossings(_errors(spark, sf_dir), key="error_type", ts="ts", id_col="id", span_us=ALERT_SECONDS * _US, more_than=ALERT_MORE)
    return c.select("id", "error_type", F.col("n").cast("long").alias("n"), "fires")


def backoff(kind: Column, status: Column, retry_after: Column, key: Column) -> tuple[Column, Column]:
    """The wait in ms that an error asks for, and a jitter that spreads retries, the same whenever it is asked for ``key``."""
    wait = (
        F.when(kind == "rate_limit", F.when(retry_after > 0, retry_after * 1000).otherwise(WAITS["rate_limit"]))
        .when(kind == "quota_exceeded", WAITS["quota_exceeded"])
        .when(status == 429, WAITS["429"])
        .otherwise(WAITS["other"])
    )
    return wait.cast("long"), _hash(key, JITTER_MS)


def error_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait after each error of the log, by kind, server hint and status."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), k.alias("k"))
    kind = F.get(strings(["rate_limit", "quota_exceeded", "network", "api_error"]), (F.col("k") % 4).cast("int"))
    e = e.select("id", kind.alias("kind"), F.when(F.col("k") % 3 == 0, 429).otherwise(500).alias("status"), F.when(F.col("k") % 5 > 1, F.col("k") % 5).alias("hint"))
    wait, jitter = backoff(F.col("kind"), F.col("status"), F.col("hint"), F.col("id").cast("string"))
    return e.select("id", "kind", wait.alias("wait_ms"), jitter.alias("jitter_ms"), (wait + jitter).alias("total_ms"))


# --- resolutions ------------------------------------------------------------------------------------------------


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of updates: what is not an error resolves or reopens an event shortly before it (``error_id``)."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").filter("event_type <> 'error' AND ts IS NOT NULL")
    return e.select((F.col("event_id") - 1 - k % 4).alias("error_id"), (k % 3 > 0).alias("resolved"), F.col("ts").alias("at"), F.col("event_id").alias("update_id"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = queueing.latest(resolutions(spark, sf_dir), key="error_id", order=("at", "update_id"), values=("resolved",))
    e = _errors(spark, sf_dir).join(last.withColumnRenamed("error_id", "id"), "id", "left")
    return e.withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def mark_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the last day of the log and whether the last update by id and time says they are resolved."""
    e = _resolved(spark, sf_dir)
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("as_of"))
    return e.join(F.broadcast(now), F.col("ts") >= F.col("as_of") - F.expr("INTERVAL '24' HOUR")).select("id", "error_type", "resolved")


def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of errors by type and hour, of all, retryable, resolved ones and those of the last hour, in one pass."""
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("as_of"))
    e = _resolved(spark, sf_dir).crossJoin(F.broadcast(now))  # one row
    said = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    every = F.lit("all")
    tags = F.array(
        said("type", F.col("error_type")),
        said("hour", F.hour("ts").cast("string")),
        said("total", every),
        F.when(~F.col("error_type").isin("configuration_error", "validation_failure"), said("retryable", every)),
        F.when(F.col("resolved"), said("resolved", every)),
        F.when(F.col("ts") >= F.col("as_of") - F.expr("INTERVAL '1' HOUR"), said("recent", F.lit("1h"))),
    )
    tagged = e.select(F.explode(tags).alias("tag")).filter("tag IS NOT NULL")
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select("tag.kind", "tag.name", "n")


# --- cost windows -----------------------------------------------------------------------------------------------

#: One text for all windows: its parameters are the time it is asked at and the spans, by name, in seconds.
COST_WINDOWS = """
SELECT span.name AS span, api_type, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS n
FROM (SELECT *, explode(:spans) AS span FROM {usage})
WHERE ts >= coalesce(CAST(:as_of AS TIMESTAMP_NTZ), (SELECT max(ts) FROM {usage})) - make_interval(0, 0, 0, 0, 0, 0, span.seconds)
  AND ts <= coalesce(CAST(:as_of AS TIMESTAMP_NTZ), (SELECT max(ts) FROM {usage}))
GROUP BY span.name, api_type"""
SPANS = {"daily": 86_400, "weekly": 7 * 86_400, "monthly": 30 * 86_400}


def cost_windows(usage: DataFrame, spans: dict[str, int], as_of: str | None = None) -> DataFrame:
    """``span``, ``api_type``, ``cost``, ``n`` of the windows that end at ``as_of`` (None: the newest record), both ends included."""
    told = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("seconds")) for k, v in spans.items()])
    return usage.sparkSession.sql(COST_WINDOWS, args={"spans": told, "as_of": as_of}, usage=usage)


def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of the last day, week and month by API and in all."""
    w = cost_windows(_usage(spark, sf_dir).select("ts", "api_type", "cost"), SPANS)
    apis = {"openrouter": F.col("api_type") == "openrouter", "huggingface": F.col("api_type") == "huggingface", "total": F.lit(True)}
    return w.agg(*[F.coalesce(F.round(F.sum(F.when((F.col("span") == s) & is_, F.col("cost"))), 8), F.lit(0.0)).alias(f"{s}_{a}") for s in SPANS for a, is_ in apis.items()])


# --- health, statistics -----------------------------------------------------------------------------------------


def services_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hour: a service is up unless its last call of the hour was an error of its own; validation needs no calls.

    Calls of the model are those of users of odd id, calls of the refinement the others.  A service without calls in
    an hour is not configured, which counts as down.  Validation is down where it raised errors alone.
    """
    own = F.when(F.col("user_id") % 2 == 1, "llama").otherwise("refinement")
    e = table(spark, sf_dir, "events").filter("ts IS NOT NULL").select(F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", own.alias("service"), (F.col("event_type") != "error").alias("ok"), (F.get_json_object("props", "$.k").cast("long") % 8 == 5).alias("rule"))
    last = lambda s: F.max(F.when(F.col("service") == s, F.struct("ts", "event_id", "ok")))["ok"]
    broken = F.count_if(~F.col("ok") & F.col("rule")) > 0
    by = e.groupBy("hour").agg(last("llama").alias("llama"), last("refinement").alias("refinement"), (~(broken & (F.count_if("ok") == 0))).alias("validation"))
    up = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = up("llama").cast("int") + up("refinement").cast("int") + up("validation").cast("int")
    details = F.concat_ws(
        "; ",
        F.when(~up("llama"), "Llama service not available"),
        F.when(F.col("refinement").isNull(), "No refinement service configured").when(~F.col("refinement"), "OpenRouter service not available"),
    )
    overall = F.when(n == 3, "healthy").when(n > 0, "degraded").otherwise("unhealthy")
    return by.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), n.cast("long").alias("n"), overall.alias("overall"), details.alias("details"))


def services_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of what all services say of themselves: model, refinement, configuration and metrics."""
    e = _topics_of_events(spark, sf_dir)
    m = e.agg(F.count(F.lit(1)).alias("totalGenerations"), F.count_if("success").alias("successes"), F.sum(F.when(F.col("success"), F.col("ms"))).cast("long").alias("totalMs"))
    x = _errors(spark, sf_dir)
    by = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))))
    errors = x.groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).agg(by.alias("errors"))  # a row for each of eight types
    calls = _usage(spark, sf_dir).agg(*[F.count_if(F.col("api_type") == a).alias(a) for a in ("openrouter", "huggingface")])
    environment = {e: (r, t) for e, r, t, *_ in ENVIRONMENTS}["production"]
    one = m.crossJoin(errors).crossJoin(calls)  # tables of one row
    doc = F.concat(
        F.lit(f'{{"llamaService":{{"modelId":"{MODEL_SETTINGS[0][0]}","requests":'), F.col("huggingface"),
        F.lit('},"refinementService":{"provider":"'), F.when(F.col("openrouter") > 0, "openrouter").otherwise("none"), F.lit('","status":"'),
        F.when(F.col("openrouter") > 0, "configured").otherwise("not_configured"), F.lit('","requests":'), F.col("openrouter"),
        F.lit(f'}},"config":{{"maxRetries":{environment[0]},"timeoutMs":{environment[1]}}},"metrics":{{"totalGenerations":'), F.col("totalGenerations"),
        F.lit(',"successes":'), F.col("successes"), F.lit(',"totalMs":'), F.coalesce("totalMs", F.lit(0)), F.lit(',"errorsByType":'), F.col("errors"), F.lit("}}"),
    )
    return one.select(doc.alias("document"))


def response_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client shows of answers in six shapes, whose question is the text of a document."""
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    q = F.struct(F.col("t").alias("questionText"), strings(["a", "b"]).alias("options"), F.lit("C").alias("correctAnswer"))
    said = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    form = F.struct(F.lit("F").alias("question"), strings(["x", "y"]).alias("options"), F.lit(1).alias("correct"))
    k = F.pmod("id", F.lit(6))
    body = (
        F.when(k == 0, said(success=F.lit(True), question=q, formatted=form))
        .when(k == 1, said(success=F.lit(True), question=q))
        .when(k == 2, said(success=F.lit(False), question=F.struct(F.lit("n").alias("question"), F.col("t").alias("questionText")), formatted=F.struct(F.lit(2).alias("correct"))))
        .when(k == 3, said(question=q))
        .when(k == 4, said(success=F.lit(False), question=q))
        .otherwise(said(questionText=F.col("t"), options=strings(["p"]), correctAnswer=F.lit("A")))
    )
    r = d.select("id", records.shown_question(body).alias("x"))
    return r.select("id", F.md5(F.col("x.question_text").cast("binary")).alias("question_md5"), F.array_join("x.options", "|").alias("options"), "x.correct_answer")


# --- exports ----------------------------------------------------------------------------------------------------

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_ISO_SQL = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'".format


def _iso(ts: str) -> Column:
    return F.date_format(ts, _ISO)


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the CSV export of generations: the header, then a line for each record, in the order of ``line_no``."""
    e = _topics_of_events(spark, sf_dir)
    line = F.concat_ws(",", _iso("ts"), "topic", F.col("success").cast("string"), F.col("ms").cast("string"))
    head = spark.createDataFrame([(-1, "timestamp,topic,success,processingTime")], "line_no long, line string")
    return head.unionByName(e.select(F.col("id").alias("line_no"), line.alias("line")))


def cost_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the CSV export of costs, header first; quotes inside a field are doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    u = _usage(spark, sf_dir).withColumn("metadata", F.to_json(F.struct(F.col("operation").alias("op"))))
    line = F.concat_ws(",", _iso("ts"), "api_type", "operation", F.col("tokens").cast("string"), F.col("cost").cast("decimal(18,7)").cast("string"), quoted(F.col("metadata")))
    head = spark.createDataFrame([(-1, "timestamp,apiType,operation,tokens,cost,metadata")], "line_no long, line string")
    return head.unionByName(u.select(F.col("id").alias("line_no"), line.alias("line")))


def _ordered(df: DataFrame, *columns: Column) -> DataFrame:
    """Rows of a section, in the order of time and id."""
    return df.select(*columns, F.concat(_iso("ts"), F.lpad(F.col("id").cast("string"), 20, "0")).alias("_order"))


def telemetry_sections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | str]:
    """The export of all telemetry: every generation, every error, and the summary."""
    e, x = _topics_of_events(spark, sf_dir), _errors(spark, sf_dir)
    s = e.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"), F.max("ts").alias("ts")).first()
    at = spark.range(1).select(F.lit(s["ts"]).alias("ts")).select(_iso("ts")).first()[0]
    return {
        "generationMetrics": _ordered(e, F.col("id"), _iso("ts").alias("timestamp"), F.col("topic"), F.col("success"), F.col("ms").alias("processingTime")),
        "errorMetrics": _ordered(x, F.col("id"), _iso("ts").alias("timestamp"), F.col("error_type").alias("errorType")),
        "summary": f'{{"totalGenerations":{s["n"]},"successes":{s["ok"]}}}',
        "exportedAt": f'"{at}"' if at else "null",
    }


def cost_sections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | str]:
    """The export of all costs: records, budget alerts, summary, breakdown and projections."""
    u = _usage(spark, sf_dir)
    text = lambda c, scale=7: F.col(c).cast(f"decimal(20,{scale})").cast("string")
    records = _ordered(u, F.col("id"), _iso("ts").alias("timestamp"), F.col("api_type").alias("apiType"), F.col("operation"), F.col("tokens"), text("cost").alias("cost"))
    by = u.groupBy("api_type", "operation").agg(F.count(F.lit(1)).alias("count"), F.sum("cost").alias("total"))
    windows = cost_windows(u.select("ts", "api_type", "cost"), SPANS | {"hour": 3600})
    spent = windows.filter("span = 'daily'").select("api_type", F.col("cost").alias("spent"))
    budget = u.groupBy("api_type").agg(F.max(F.col("day_cost").cast("decimal(12,4)")).alias("budget")).join(spent, "api_type", "left")
    used = F.coalesce(F.col("spent"), F.lit(0.0)) / F.col("budget").cast("double")
    level = F.when(used >= 1, "exceeded").when(used >= 0.9, "critical").when(used >= 0.7, "warning").otherwise("ok")
    totals = {r["span"]: r["cost"] for r in windows.groupBy("span").agg(F.round(F.sum("cost"), 7).cast("decimal(20,7)").cast("string").alias("cost")).collect()}
    named = ",".join(f'"{k}":"{totals.get(k, "0.0000000")}"' for k in SPANS)
    return {
        "costRecords": records,
        "budgetAlerts": budget.select(F.col("api_type").alias("apiType"), level.alias("level"), F.col("api_type").alias("_order")),
        "summary": "{" + named + "}",
        "breakdown": by.select(F.col("api_type").alias("apiType"), "operation", "count", text("total").alias("total"), F.concat_ws("/", "api_type", "operation").alias("_order")),
        "projections": f'{{"burnRate":"{totals.get("hour", "0.0000000")}"}}',
    }


def _digest(lines: DataFrame, sections: dict) -> DataFrame:
    """By section of a document: rows, characters without separators, and a sum over hashes of the rows."""
    row = F.regexp_replace("line", "^,", "")
    names = F.array(*map(F.lit, sections))
    own = lines.filter("place = 1 OR `order` = ''").filter((F.col("place") == 1) | ~F.col("section").isin([i for i, x in enumerate(sections.values()) if isinstance(x, DataFrame)]))
    own = own.select(F.get(names, F.col("section")).alias("section"), F.when(F.col("place") == 1, row).otherwise(F.regexp_replace("line", r'^\{?"\w+":|[,}]?$', "")).alias("row"))
    own = own.withColumn("row", F.when(F.col("row").startswith("{") & ~F.col("row").endswith("}"), F.concat("row", F.lit("}"))).otherwise(F.col("row")))
    return own.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("row")).alias("chars"), F.sum(_hash(F.col("row"), 1 << 32)).alias("hashes"))


def telemetry_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the sections of the whole telemetry export, as :func:`sinks.write_document` writes it."""
    s = telemetry_sections(spark, sf_dir)
    return _digest(sinks.document_lines(s, spark), s)


def cost_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cost_sections(spark, sf_dir)
    return _digest(sinks.document_lines(s, spark), s)


def _digest_sql(parts: dict[str, str]) -> str:
    own = " UNION ALL ".join(f"SELECT '{k}' AS section, row FROM ({v}) AS t(row)" for k, v in parts.items())
    return f"SELECT section, count(*)::BIGINT AS n, sum(length(row))::BIGINT AS chars, sum({_HASH_SQL('row', 1 << 32)})::BIGINT AS hashes FROM ({own}) GROUP BY 1"


_NOW = "(SELECT max(ts) FROM events)"
_RESOLVED_SQL = f"""upd AS (SELECT event_id - 1 - json_extract_string(props, '$.k')::BIGINT % 4 AS id, json_extract_string(props, '$.k')::BIGINT % 3 > 0 AS resolved, ts AS told, event_id AS u FROM events WHERE event_type <> 'error'),
res AS (SELECT err.*, coalesce((SELECT arg_max(resolved, (told, u)) FROM upd WHERE upd.id = err.id), false) AS resolved FROM err)"""
_KINDS = ", ".join(f"'{k}'" for k in ("rate_limit", "quota_exceeded", "network", "api_error"))
_WINDOW = "round(coalesce(sum(cost) FILTER (WHERE ts >= {now} - INTERVAL '{days}' DAY{api}), 0)::DOUBLE, 8)".format

ORACLES: dict[str, str] = {
    "delay_queue": f"""WITH RECURSIVE {USAGE_SQL},
q AS MATERIALIZED (SELECT id, api_type, epoch_us(ts) AS t, rpm, row_number() OVER (PARTITION BY api_type ORDER BY ts, id) - 1 AS i FROM use),
r AS (SELECT id, api_type, t, rpm, i, t AS release FROM q WHERE i < rpm
  UNION ALL SELECT q.id, q.api_type, q.t, q.rpm, q.i, greatest(q.t, r.release + {QUEUE_SECONDS * _US}) FROM r JOIN q ON q.api_type = r.api_type AND q.i = r.i + r.rpm)
SELECT id, api_type, release::BIGINT AS release_us, floor((release - t) / 1000)::BIGINT AS wait_ms FROM r""",
    "rate_limit_wait": f"""WITH {USAGE_SQL},
w AS (SELECT *, count(*) OVER m AS n, min(ts) OVER m AS oldest FROM use WINDOW m AS (PARTITION BY api_type ORDER BY ts RANGE BETWEEN INTERVAL '60' SECOND PRECEDING AND INTERVAL '1' MICROSECOND PRECEDING))
SELECT id, api_type, n::BIGINT AS n, CASE WHEN n >= rpm THEN 60000 - floor((epoch_us(ts) - epoch_us(oldest)) / 1000)::BIGINT ELSE 0 END AS wait_ms FROM w""",
    "error_alerts": f"""WITH {_ERRORS_SQL},
c AS (SELECT e.id, e.error_type, e.ts, count(*) AS n FROM err e JOIN err o ON o.error_type = e.error_type AND o.ts >= e.ts - INTERVAL '{ALERT_SECONDS}' SECOND AND (o.ts < e.ts OR o.ts = e.ts AND o.id <= e.id) GROUP BY ALL)
SELECT id, error_type, n::BIGINT AS n, n > {ALERT_MORE} AND coalesce(lag(n) OVER (PARTITION BY error_type ORDER BY ts, id), 0) <= {ALERT_MORE} AS fires FROM c""",
    "error_backoff": f"""WITH e AS (SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'error'),
w AS (SELECT id, [{_KINDS}][k % 4 + 1] AS kind, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 5 IN (2, 3, 4) THEN k % 5 * 1000 ELSE 5000 END WHEN k % 4 = 1 THEN 60000 WHEN k % 3 = 0 THEN 10000 ELSE 1000 END AS wait, {_HASH_SQL("event_id::VARCHAR", JITTER_MS).replace("event_id", "id")} AS jitter FROM e)
SELECT id, kind, wait::BIGINT AS wait_ms, jitter::BIGINT AS jitter_ms, (wait + jitter)::BIGINT AS total_ms FROM w""",
    "mark_resolved": f"WITH {_ERRORS_SQL}, {_RESOLVED_SQL} SELECT id, error_type, resolved FROM res WHERE ts >= {_NOW} - INTERVAL 24 HOUR",
    "error_stats": f"""WITH {_ERRORS_SQL}, {_RESOLVED_SQL},
t AS (SELECT 'type' AS kind, error_type AS name FROM res UNION ALL SELECT 'hour', extract('hour' FROM ts)::VARCHAR FROM res UNION ALL SELECT 'total', 'all' FROM res
  UNION ALL SELECT 'retryable', 'all' FROM res WHERE error_type <> 'configuration_error' AND error_type <> 'validation_failure'
  UNION ALL SELECT 'resolved', 'all' FROM res WHERE resolved UNION ALL SELECT 'recent', '1h' FROM res WHERE {_NOW} - ts <= INTERVAL 1 HOUR)
SELECT kind, name, count(*)::BIGINT AS n FROM t GROUP BY ALL""",
    "cost_summary": f"WITH {USAGE_SQL} SELECT "
    + ", ".join(
        f"{_WINDOW(now=_NOW, days=days, api=api)} AS {name}_{col}"
        for name, days in (("daily", 1), ("weekly", 7), ("monthly", 30))
        for col, api in (("openrouter", " AND api_type = 'openrouter'"), ("huggingface", " AND api_type = 'huggingface'"), ("total", ""))
    )
    + " FROM use",
    "services_health": """WITH e AS (SELECT date_trunc('hour', ts) AS h, ts, event_id, user_id % 2 = 1 AS llama, event_type <> 'error' AS ok, json_extract_string(props, '$.k')::BIGINT % 8 = 5 AS rule FROM events),
s AS (SELECT h, coalesce(arg_max(ok, (ts, event_id)) FILTER (WHERE llama), false) AS l, arg_max(ok, (ts, event_id)) FILTER (WHERE NOT llama) AS r, bool_or(ok) OR NOT bool_or(rule) AS v FROM e GROUP BY 1),
c AS (SELECT *, l::INT + coalesce(r, false)::INT + v::INT AS n FROM s)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, n::BIGINT AS n, CASE n WHEN 3 THEN 'healthy' WHEN 0 THEN 'unhealthy' ELSE 'degraded' END AS overall,
  concat_ws('; ', CASE WHEN NOT l THEN 'Llama service not available' END, CASE WHEN r IS NULL THEN 'No refinement service configured' WHEN NOT r THEN 'OpenRouter service not available' END) AS details FROM c""",
    "services_stats": f"""WITH {_EVENTS_SQL}, {_ERRORS_SQL}, b AS (SELECT error_type, count(*) AS n FROM err GROUP BY 1),
j AS (SELECT coalesce(string_agg('"' || error_type || '":' || n, ',' ORDER BY error_type), '') AS errors FROM b),
a AS (SELECT count(*) FILTER (WHERE user_id % 2 = 0) AS o, count(*) FILTER (WHERE user_id % 2 <> 0) AS h FROM events),
m AS (SELECT count(*) AS n, count(*) FILTER (WHERE success) AS ok, coalesce(sum(ms) FILTER (WHERE success), 0) AS ms FROM ev)
SELECT '{{"llamaService":{{"modelId":"{MODEL_SETTINGS[0][0]}","requests":' || h || '}},"refinementService":' || CASE WHEN o > 0 THEN '{{"provider":"openrouter","status":"configured"' ELSE '{{"provider":"none","status":"not_configured"' END
  || ',"requests":' || o || '}},"config":{{"maxRetries":3,"timeoutMs":60000}},"metrics":{{"totalGenerations":' || n || ',"successes":' || ok || ',"totalMs":' || ms || ',"errorsByType":{{' || errors || '}}}}}}' AS document FROM m, a, j""",
    "response_view": """WITH d AS (SELECT doc_id AS id, doc_id % 6 AS k, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT id, CASE WHEN k = 0 THEN md5('F') WHEN k = 4 OR t = '' THEN NULL ELSE md5(t) END AS question_md5, CASE WHEN k = 0 THEN 'A) x|B) y' WHEN k IN (1, 3) AND t <> '' THEN 'a|b' WHEN k = 5 AND t <> '' THEN 'p' END AS options,
  CASE WHEN k = 0 THEN 'B' WHEN k = 4 OR t = '' THEN NULL WHEN k = 5 THEN 'A' ELSE 'C' END AS correct_answer FROM d""",
    "csv_export": f"""WITH {_EVENTS_SQL} SELECT -1 AS line_no, 'timestamp,topic,success,processingTime' AS line
UNION ALL SELECT id, {_ISO_SQL("ts")} || ',' || topic || ',' || CASE WHEN success THEN 'true' ELSE 'false' END || ',' || ms FROM ev""",
    "cost_csv_export": f"""WITH {USAGE_SQL} SELECT -1 AS line_no, 'timestamp,apiType,operation,tokens,cost,metadata' AS line
UNION ALL SELECT id, {_ISO_SQL("ts")} || ',' || api_type || ',' || operation || ',' || tokens || ',' || cost::DECIMAL(18, 7) || ',"{{""op"":""' || operation || '""}}"' FROM use""",
    "telemetry_document": f"WITH {_EVENTS_SQL}, {_ERRORS_SQL} "
    + _digest_sql(
        {
            "generationMetrics": f"""SELECT '{{"id":' || id || ',"timestamp":"' || {_ISO_SQL("ts")} || '","topic":"' || topic || '","success":' || CASE WHEN success THEN 'true' ELSE 'false' END || ',"processingTime":' || ms || '}}' FROM ev""",
            "errorMetrics": f"""SELECT '{{"id":' || id || ',"timestamp":"' || {_ISO_SQL("ts")} || '","errorType":"' || error_type || '"}}' FROM err""",
            "summary": """SELECT '{"totalGenerations":' || count(*) || ',"successes":' || count(*) FILTER (WHERE success) || '}' FROM ev""",
            "exportedAt": f"""SELECT '"' || {_ISO_SQL("max(ts)")} || '"' FROM ev""",
        }
    ),
    "cost_document": f"""WITH {USAGE_SQL}, d AS (SELECT api_type, any_value(day_cost)::DECIMAL(12, 4)::DOUBLE AS budget, coalesce(sum(cost) FILTER (WHERE ts >= {_NOW} - INTERVAL 1 DAY), 0)::DOUBLE AS spent FROM use GROUP BY 1),
w AS (SELECT {", ".join(f"coalesce(sum(cost) FILTER (WHERE ts >= {_NOW} - INTERVAL {x}), 0)::DECIMAL(20, 7) AS {n}" for n, x in (("a", "1 DAY"), ("b", "7 DAY"), ("c", "30 DAY"), ("h", "1 HOUR")))} FROM use) """
    + _digest_sql(
        {
            "costRecords": f"""SELECT '{{"id":' || id || ',"timestamp":"' || {_ISO_SQL("ts")} || '","apiType":"' || api_type || '","operation":"' || operation || '","tokens":' || tokens || ',"cost":"' || cost::DECIMAL(20, 7) || '"}}' FROM use""",
            "budgetAlerts": """SELECT '{"apiType":"' || api_type || '","level":"' || CASE WHEN spent >= budget THEN 'exceeded' WHEN spent / budget >= 0.9 THEN 'critical' WHEN spent / budget >= 0.7 THEN 'warning' ELSE 'ok' END || '"}' FROM d""",
            "summary": """SELECT '{"daily":"' || a || '","weekly":"' || b || '","monthly":"' || c || '"}' FROM w""",
            "breakdown": """SELECT '{"apiType":"' || api_type || '","operation":"' || operation || '","count":' || count(*) || ',"total":"' || sum(cost)::DECIMAL(20, 7) || '"}' FROM use GROUP BY api_type, operation""",
            "projections": """SELECT '{"burnRate":"' || h || '"}' FROM w""",
        }
    ),
}
QUERIES = {name: globals()[name] for name in ORACLES}
