"""Queries over records, settings, limits and trailing windows; expected SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import hits, let, strings
from ..functions.dims import LIMITS, METERED, OPERATION_COSTS, TOPICS, values
from ..operators import parsing, providers, records, trailing, validation
from ..sources.tables import table
from . import questions as Q
from .questions import _BLANKS, _TOPICS_SQL, _W, QUESTIONS_SQL, _joined

_LIMIT_COLUMNS = "profile string, api_type string, rpm int, rpd int, tpm long, tpd long, token_cost string, day_cost string"
_US = 1_000_000
USAGE_SQL = f"""prices(profile, api_type, rpm, rpd, tpm, tpd, token_cost, day_cost) AS ({values(METERED)}),
use AS (SELECT event_id AS id, ts, p.api_type, event_type AS operation, round(value * 10)::BIGINT AS tokens, (round(value * 10)::BIGINT * token_cost::DECIMAL(10, 7))::DECIMAL(20, 10) AS cost, rpm, rpd, tpm, tpd, day_cost
  FROM events JOIN prices p ON p.api_type = CASE WHEN user_id % 2 = 0 THEN 'openrouter' ELSE 'huggingface' END)"""
_MS = "CAST(floor(epoch_us({}) / 1000) AS BIGINT)".format


def _limits(spark: SparkSession, rows=LIMITS) -> DataFrame:
    return spark.createDataFrame(rows, _LIMIT_COLUMNS)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``ts``, ``api_type``, ``operation``, ``tokens``, ``cost`` and the limits of the API."""
    api = F.when(F.col("user_id") % 2 == 0, "openrouter").otherwise("huggingface")
    tokens = F.round(F.col("value") * 10).cast("long")
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", api.alias("api_type"), F.col("event_type").alias("operation"), tokens.alias("tokens"))
    own = own.join(F.broadcast(_limits(spark, METERED)), "api_type")
    return own.withColumn("cost", (F.col("tokens") * F.col("token_cost").cast("decimal(10,7)")).cast("decimal(20,10)"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, dims.ERROR_TYPES))
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), "ts", "user_id", F.get(kinds, (k % 8).cast("int")).alias("error_type"))


_ERRORS_SQL = f"""err AS (SELECT event_id AS id, ts, user_id, list_extract([{", ".join(f"'{e}'" for e in dims.ERROR_TYPES)}], (json_extract_string(props, '$.k')::BIGINT % 8 + 1)) AS error_type FROM events WHERE event_type = 'error')"""


# --- trailing windows -------------------------------------------------------------------------------------------


def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the limits say of each request, given all that the log holds before it: a full day rejects, a full minute delays."""
    u = _usage(spark, sf_dir)
    w = trailing.trailing(u, key="api_type", ts="ts", id_col="id", measures=("tokens", "cost"), spans={"minute": 60 * _US, "day": 86_400 * _US})
    w = w.join(F.broadcast(_limits(spark, METERED)), "api_type")
    decision = (
        F.when(F.col("cost_day") >= F.col("day_cost").cast("decimal(20,10)"), "reject_cost")
        .when(F.col("n_day") >= F.col("rpd"), "reject_requests")
        .when(F.col("tokens_day") >= F.col("tpd"), "reject_tokens")
        .when(F.col("n_minute") >= F.col("rpm"), "delay")
        .when(F.col("tokens_minute") >= F.col("tpm"), "delay_tokens")
        .otherwise("admit")
    )
    return w.select("id", "api_type", decision.alias("decision"), "n_minute", "n_day", "tokens_day", F.col("cost_day").cast("double").alias("cost_day"))


def retry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a type in the five minutes before, and whether another retry is due."""
    w = trailing.trailing(_errors(spark, sf_dir), key="error_type", ts="ts", id_col="id", spans={"span": 300 * _US})
    most = F.when(F.col("error_type") == "llama_failure", 3).otherwise(2)
    retry = ~F.col("error_type").isin("configuration_error", "api_limit") & (F.col("n_span") < most)
    return w.select("id", "error_type", F.col("n_span").alias("n"), retry.alias("retry"))


def _topics_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.get(F.array(*[F.lit(t[0]) for t in TOPICS]), (F.col("user_id") % 29).cast("int"))
    ms = F.round(F.col("value") * 200).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", topic.alias("topic"), "user_id", (F.col("event_type") != "error").alias("success"), ms.alias("ms"))


_EVENTS_SQL = f"""topics(ord, topic, display, hl, context) AS ({_TOPICS_SQL}),
ev AS (SELECT event_id AS id, ts, topic, user_id, event_type <> 'error' AS success, round(value * 200)::BIGINT AS ms FROM events JOIN topics ON ord = user_id % 29)"""


def chunks_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.ordinal(_topics_of_events(spark, sf_dir), key="topic", ts="ts", id_col="id").select("id", F.floor((F.col("ordinal") - 1) / 3).alias("chunk"))


def history_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five questions of each user, newest first, numbered from the end."""
    e = _topics_of_events(spark, sf_dir)
    w = Window.partitionBy("user_id")
    newest = w.orderBy(F.desc("ts"), F.desc("id"))
    out = e.select("user_id", "id", "topic", F.row_number().over(newest).alias("r"), F.count(F.lit(1)).over(w).alias("n")).filter("r <= 5")
    title = F.initcap(F.replace("topic", F.lit("-"), F.lit(" ")))
    return out.select(F.col("user_id").cast("long").alias("user_id"), "id", F.concat(F.lit("Q"), (F.col("n") - F.col("r") + 1).cast("string"), F.lit(": "), title).alias("label"))


def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user at a topic on a day, numbered; whether one more is allowed (three), and its delay."""
    e = _topics_of_events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    n = F.row_number().over(Window.partitionBy("user_id", "topic", "day").orderBy("ts", "id"))
    return e.select("id", n.cast("long").alias("attempt")).select("id", "attempt", (F.col("attempt") < 3).alias("again"), F.least(F.pow(F.lit(2.0), F.col("attempt") - 1) * 1000, F.lit(10000.0)).cast("long").alias("delay_ms"))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _topics_of_events(spark, sf_dir).groupBy(F.col("user_id").cast("long").alias("user_id"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.max_by("ms", F.struct("ts", "id")).alias("last_ms"), F.least(F.count(F.lit(1)), F.lit(5)).cast("long").alias("history"))


# --- questions, requests, errors --------------------------------------------------------------------------------


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a refined response made of their options, in several shapes."""
    q = Q.questions(table(spark, sf_dir, "documents"))
    line = lambda i: F.concat(F.coalesce(F.translate(F.get("options", F.lit(i)), "\n\r", "  "), F.lit("")), F.lit("\n"))
    head = F.when(F.col("id") % 5 == 0, "").otherwise("Refined Question:\nWhat follows from the text?\n\n")
    tail = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("\nCORRECT_ANSWER: "), "answer", F.lit("\n\nIMPROVEMENTS_MADE:\n- shorter\n- well-formed\n- one\n- two")))
    return q.withColumn("response", F.concat(head, *[line(i) for i in range(4)], tail))


_REFINED_SQL = rf"""{QUESTIONS_SQL},
rf AS (SELECT id, topic, t, o, answer, CASE WHEN id % 5 = 0 THEN '' ELSE 'Refined Question:' || chr(10) || 'What follows from the text?' || chr(10) || chr(10) END
    || coalesce(translate(o[1], chr(10) || chr(13), '  '), '') || chr(10) || coalesce(translate(o[2], chr(10) || chr(13), '  '), '') || chr(10) || coalesce(translate(o[3], chr(10) || chr(13), '  '), '') || chr(10) || coalesce(translate(o[4], chr(10) || chr(13), '  '), '') || chr(10)
    || CASE WHEN id % 3 = 0 THEN '' ELSE chr(10) || 'CORRECT_ANSWER: ' || answer || chr(10) || chr(10) || 'IMPROVEMENTS_MADE:' || chr(10) || '- shorter' || chr(10) || '- well-formed' || chr(10) || '- one' || chr(10) || '- two' END AS r FROM q),
rm AS (SELECT *, regexp_replace(r, '\n([A-D]\)|CORRECT_ANSWER)', chr(1) || chr(10) || '\1', 'g') || chr(1) AS m FROM rf),
ro AS (SELECT *, regexp_extract_all(m, '([A-D]\)(?:{_W}|\x01)*[^\n\r\x01]+?)\x01', 1) AS oo FROM rm),
rr AS (SELECT id, topic, t, o, answer, r,
    CASE WHEN regexp_matches(r, '(?i)Refined Question:[\s\S]*?([A-D]\)|CORRECT_ANSWER)') THEN trim(regexp_extract(r, '(?i)Refined Question:{_W}*([\s\S]*?)(?:[A-D]\)|CORRECT_ANSWER)', 1), {_BLANKS}) ELSE t END AS rt,
    CASE WHEN len(oo) = 4 THEN list_transform(oo, lambda x: substr(x, 1, 1) || ') ' || trim(regexp_replace(x, '^[A-D]\){_W}*', ''), {_BLANKS})) ELSE o END AS rop,
    coalesce(nullif(regexp_extract(r, '(?i)CORRECT_ANSWER:{_W}*([A-D])', 1), ''), answer) AS ra,
    CASE WHEN id % 3 = 0 THEN [] ELSE ['shorter', 'well', 'formed', 'one', 'two'] END AS imp FROM ro)"""


def _refined_column() -> Column:
    return parsing.parse_refined(F.col("response"), F.coalesce("question_text", F.lit("")), F.col("options"), F.col("answer"))


def parse_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _refined(spark, sf_dir).select("id", _refined_column().alias("x"))
    return r.select("id", F.md5(F.col("x.question_text").cast("binary")).alias("question_md5"), _joined("x.options").alias("options"), "x.answer", _joined("x.improvements").alias("improvements"))


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Q.responses(table(spark, sf_dir, "documents")).select("id", parsing.parse_lines(F.regexp_replace("response", r"(?m)^ C\. ", "C) ")).alias("x"))
    return r.select("id", F.length("x.question").cast("long").alias("question_chars"), _joined("x.options").alias("options"), "x.answer", "x.confidence")


def parse_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q.questions(table(spark, sf_dir, "documents"))
    row = F.to_json(F.struct(F.col("question_text").alias("question"), "options", F.col("answer").alias("correct_answer")))
    text = F.when(F.col("id") % 6 == 0, F.lit("no object here")).otherwise(F.concat(F.lit("Here it is: "), row, F.lit(" - done")))
    r = q.select("id", parsing.parse_json_object(text).alias("x"))
    return r.select("id", "x.question", F.size("x.options").cast("long").alias("n_options"), F.col("x.correct_answer").alias("answer")).withColumn(
        "n_options", F.when(F.col("answer").isNotNull(), F.col("n_options"))
    )


def parse_options_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option ends with its line before another, or with the section: a blank line after the last one loses it."""
    q = _refined(spark, sf_dir)
    text = F.concat(F.lit("REFINED_QUESTION: Which one holds?\n\nOPTIONS:\n"), F.concat_ws("\n", F.transform("options", lambda x: F.translate(x, "\n\r", "  "))), F.when(F.col("id") % 2 == 0, "CORRECT_ANSWER: ").otherwise("\n\nCORRECT_ANSWER: "), F.lower("answer"))
    r = q.select("id", parsing.parse_options_section(text).alias("x"))
    return r.select("id", "x.question_text", _joined("x.options").alias("options"), "x.answer")


def final_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined questions, and raw ones where refinement failed (one in four) or is off (one in nine)."""
    error = F.when(F.col("id") % 4 == 1, "OpenRouter API timeout")
    own = _refined(spark, sf_dir).withColumn("x", F.when(F.col("id") % 9 != 2, _refined_column()))
    raw = F.struct(F.coalesce("question_text", F.lit("")).alias("question_text"), "options", "answer")
    kind = F.when(F.col("id") % 2 == 0, "multiple-choice").otherwise("long-answer")
    r = own.select("id", records.final_question(raw, F.col("x"), F.col("topic"), kind, error).alias("y"))
    return r.select("id", "y.topic", F.md5(F.col("y.question_text").cast("binary")).alias("question_md5"), _joined("y.options").alias("options"), "y.correct_answer", "y.explanation", "y.refinement_applied", "y.type", "y.difficulty")


def format_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = validation.with_topics(Q.questions(table(spark, sf_dir, "documents")))
    q = q.select(
        "id", "display", F.coalesce("question_text", F.lit("")).alias("question_text"), "options", F.col("answer").alias("correct_answer"),
        F.when(F.col("id") % 3 == 0, "").otherwise("One\nTwo").alias("explanation"), F.when(F.col("id") % 2 == 0, "multiple-choice").otherwise("long-answer").alias("type"),
    )
    r = records.format_response(q)
    return r.select("id", "kind", "topic", F.md5(F.col("question").cast("binary")).alias("question_md5"), _joined("options").alias("options"), F.col("correct").cast("long").alias("correct"), _joined("solution").alias("solution"), "theory")


def fallback_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q.questions(table(spark, sf_dir, "documents")).select("id", "topic")
    return records.pick_fallback(q).select("id", "topic", "question_text", _joined("options").alias("options"), "correct_answer")


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.questions(table(spark, sf_dir, "documents")).withColumn("k", F.col("id") % 9)
    q = lambda *kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv]))
    alias = F.get(strings(["Mechanics", "waves", "Thermal", "nothing"]), (F.col("id") % 4).cast("int"))
    body = (
        F.when(d.k == 0, q(("topic", F.col("topic"))))
        .when(d.k == 1, q(("topic", F.col("topic")), ("difficulty", F.lit("higher")), ("type", F.lit("long-answer"))))
        .when(d.k == 2, q(("topic", F.col("topic")), ("difficulty", F.lit("hard"))))
        .when(d.k == 3, q(("topic", F.col("topic")), ("type", F.lit("essay"))))
        .when(d.k == 4, q(("difficulty", F.lit("higher"))))
        .when(d.k == 5, q(("topic", F.lit("cooking"))))
        .when(d.k == 6, q(("prompt", F.lit("x")), ("questionType", F.lit("mcq")), ("topics", F.array(alias))))
        .when(d.k == 7, q(("prompt", F.lit("x"))))
        .otherwise("not a request")
    )
    r = d.select("id", records.validate_request(body).alias("x"))
    return r.select("id", "x.valid", F.col("x.error").alias("error"), "x.topic", "x.difficulty", "x.type")


def error_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.get(strings(["llama", "openrouter", "refinement", "validation", ""]), (F.col("event_id") % 5).cast("int"))
    message = F.get(strings(["request timeout", "quota reached", "rate limit", "socket closed", "401 Unauthorized", "API key not valid"]), (F.col("user_id") % 6).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), stage.alias("stage"), F.when(F.col("event_id") % 7 != 0, message).alias("message"))
    r = e.select("id", "message", records.normalise_error(F.col("stage"), F.col("message")).alias("x"))
    return r.select("id", F.col("x.type").alias("error_type"), F.col("x.message").alias("text"), "x.retryable", records.is_auth_error(F.col("message")).alias("abort"))


def error_to_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", records.status_of(F.col("text")).alias("x")).select("doc_id", F.col("x.status").cast("long").alias("status"), "x.code")


def outcome_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch (day and topic) fails only if all of its requests do; others go on with what is left."""
    e = _topics_of_events(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day"), "topic")
    ok, bad = F.count_if(F.col("success")), F.count_if(~F.col("success"))
    return e.agg(F.when((ok == 0) & (bad > 0), "all failed").otherwise("some passed").alias("outcome"), ok.alias("kept"), bad.alias("dropped"))


def sanity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q.questions(table(spark, sf_dir, "documents"))
    return q.select("id", records.sane(F.col("question_text"), F.col("options"), F.col("answer"), (F.col("id") % 20) / 20.0).alias("sane"))


# --- JSON and text shapes ---------------------------------------------------------------------------------------


def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").withColumn("t", F.coalesce("text", F.lit("")))
    s = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    text = F.struct(F.col("t").alias("text"))
    raw = (
        F.when(d.doc_id % 6 == 0, s(results=F.array(text)))
        .when(d.doc_id % 6 == 1, s(generated_text=d.t))
        .when(d.doc_id % 6 == 2, s(output=F.array(text)))
        .when(d.doc_id % 6 == 3, s(output=F.array(F.struct(F.col("t").alias("generated_text")))))
        .when(d.doc_id % 6 == 4, s(data=F.array(text)))
        .otherwise(d.t)
    )
    return d.select("doc_id", parsing.json_envelope(raw).alias("content"))


def json_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").withColumn("t", F.translate(F.coalesce("text", F.lit("")), "{}", "()"))
    head = F.when(d.doc_id % 4 == 0, r'{"a": {"b": "}\\"{"}} ').when(d.doc_id % 4 == 1, '{"output": "inner", "x": {}}').when(d.doc_id % 4 == 2, "{broken} ").otherwise("")
    body = F.when(d.doc_id % 4 == 1, "").otherwise(d.t)
    return d.select("doc_id", parsing.json_tail(F.concat(head, body)).alias("tail"))


def text_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and the file name that a question is saved under."""
    q = validation.with_topics(Q.questions(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("options", lambda x, i: F.concat(F.char(i + 65), F.lit(") "), x, F.lit("\n"))), "")
    text = F.concat(F.lit("Topic: "), "topic", F.lit("\n\nQuestion: "), F.coalesce("question_text", F.lit("")), F.lit("\n\nOptions:\n"), lines, F.lit("\nCorrect Answer: "), "answer", F.lit("\n\n"))
    name = F.concat(F.lit("physics-question-"), F.regexp_replace(F.lower("display"), r"\s+", "-"), F.lit(".txt"))
    return q.select("id", F.md5(text.cast("binary")).alias("text_md5"), name.alias("file"), F.initcap(F.replace("topic", F.lit("-"), F.lit(" "))).alias("title"))


def telemetry_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary document of an export: counts, and the newest records as a list."""
    e = _topics_of_events(spark, sf_dir)
    u = _usage(spark, sf_dir)
    newest = e.orderBy(F.desc("ts"), "id").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"].cast("string")), ",").alias("newest"))
    total = e.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"))
    cost = u.agg(F.sum("tokens").alias("tokens"), F.sum("cost").cast("decimal(18,6)").cast("string").alias("cost"))
    one = total.crossJoin(cost).crossJoin(newest)  # three tables of one row
    return one.select(F.to_json(F.struct(F.struct("n", "ok").alias("generations"), F.struct("tokens", "cost").alias("costs"), "newest")).alias("document"))


def generate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests through the provider cascade, whose first provider is offline here, parsed; failures are dropped."""
    q = validation.with_topics(Q.questions(table(spark, sf_dir, "documents"))).select("id", F.to_json(F.struct(F.concat(F.lit("Topic: "), "display").alias("input"))).alias("prompt"))
    out = providers.generate(q, [("offline", providers.offline)], keep_failures=False)
    r = out.select("id", "status", "provider", F.col("attempts").cast("long").alias("attempts"), parsing.parse(F.col("response")).alias("x"))
    return r.select("id", "status", "provider", "attempts", "x.question_text", "x.answer", "x.confidence")


# --- settings and limits ----------------------------------------------------------------------------------------


def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated against real cost, by operation of the log (static estimates by kind of operation)."""
    dim = spark.createDataFrame(OPERATION_COSTS, "kind string, estimate string")
    kind = F.when(F.col("operation") == "purchase", "batchGeneration").when(F.col("operation") == "view", "validation").otherwise("questionGeneration")
    u = _usage(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    return u.join(F.broadcast(dim), "kind").select("kind", "n", F.round(F.col("cost").cast("double"), 8).alias("cost"), F.round(F.col("n") * F.col("estimate").cast("double"), 8).alias("estimated"))


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("u"), F.col("event_type").alias("t"))
    current = F.create_map(F.lit("llamaModelId"), F.lit("old"), F.lit("theme"), F.lit("dark"))
    changes = F.create_map(F.lit("llamaModelId"), F.col("u"), F.lit("theme"), F.col("t"), F.lit("litUrl"), F.concat(F.lit("http://"), "t"), F.lit("admin"), F.lit("yes"))
    m = records.merge_settings(current, changes)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return e.select("id", flat.alias("settings"))


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), records.record_id("metric", F.col("ts"), F.col("event_id"), F.col("event_type")).alias("record_id"))


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after records older than a week go: totals by API from the log itself, and what was removed."""
    u = _usage(spark, sf_dir)
    now = u.agg(F.max("ts").alias("now"))
    own = u.crossJoin(F.broadcast(now)).withColumn("keep", F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS"))
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("keep"), F.col(c))), F.lit(0))
    return own.groupBy("api_type").agg(F.count_if("keep").alias("n"), kept("tokens").cast("long").alias("tokens"), F.round(kept("cost").cast("double"), 8).alias("cost"), F.count_if(~F.col("keep")).alias("removed"))


def _colours() -> dict[str, Column]:
    part = lambda c, k: F.pmod(F.col("event_id") * k + F.col("user_id") * (k + 2), F.lit(256)).cast("double").alias(c)
    return {c: part(c, k) for c, k in zip(("r1", "g1", "b1", "r2", "g2", "b2"), (3, 7, 11, 13, 17, 19), strict=True)}


def _contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("page"), F.when(F.col("user_id") % 2 == 0, "light").otherwise("dark").alias("theme"), *_colours().values())
    ratio = records.contrast(records.luminance(F.col("r1"), F.col("g1"), F.col("b1")), records.luminance(F.col("r2"), F.col("g2"), F.col("b2")))
    return e.select("event_id", "page", "theme", ratio.alias("ratio"))


_CONTRAST_SQL = "c AS (SELECT event_id, event_type AS page, CASE WHEN user_id % 2 = 0 THEN 'light' ELSE 'dark' END AS theme, " + ", ".join(
    f"((event_id * {k} + user_id * {k + 2}) % 256) / 255.0::DOUBLE AS {c}" for c, k in zip(("r1", "g1", "b1", "r2", "g2", "b2"), (3, 7, 11, 13, 17, 19), strict=True)
) + " FROM events),\nl AS (SELECT event_id, page, theme, " + ", ".join(
    "0.2126 * f(r{0}) + 0.7152 * f(g{0}) + 0.0722 * f(b{0}) AS l{0}".format(i).replace("f(", "lin(") for i in (1, 2)
) + " FROM c),\nr AS (SELECT event_id, page, theme, (greatest(l1, l2) + 0.05) / (least(l1, l2) + 0.05) AS ratio FROM l)"


def _lin(sql: str) -> str:
    import re

    return re.sub(r"lin\((\w+)\)", r"(CASE WHEN \1 <= 0.04045 THEN \1 / 12.92 ELSE pow((\1 + 0.055) / 1.055, 2.4) END)", sql)


def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of colour pairs by page and theme: how many there are, and how many fall below 4.5 and 3."""
    c = _contrasts(spark, sf_dir).groupBy("page", "theme")
    return c.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("ratio") < 4.5).alias("fail45"), F.count_if(F.col("ratio") < 3).alias("fail30"))


def audit_worst_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contrasts(spark, sf_dir).filter("ratio < 4.5").orderBy("ratio", "event_id").limit(12)
    return c.select("event_id", "page", "theme", F.round("ratio", 2).alias("ratio"))


# --- thin queries on the rules ----------------------------------------------------------------------------------


def _low() -> Column:
    return F.lower(F.coalesce("question_text", F.lit("")))


def difficulty_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = validation.with_topics(Q.questions(table(spark, sf_dir, "documents")))
    return q.select("id", "topic", let(_low(), lambda x: validation.difficulty(hits(x, dims.HL_WORDS), hits(x, dims.SL_WORDS))).alias("difficulty"))


def topic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = validation.with_topics(Q.questions(table(spark, sf_dir, "documents"))).select("id", "topic", let(_low(), validation.relevance).alias("r"))
    return q.select("id", "topic", F.round("r", 6).alias("relevance"), (F.col("r") < 0.5).alias("warned"), (F.col("r") < 0.3).alias("suggested"))


def style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = validation.compliance_rules(Q.questions(table(spark, sf_dir, "documents")))
    own = F.filter("c.suggestions", lambda x: ~x.startswith("Consider focusing"))
    return c.select("id", _joined(own).alias("suggestions"), F.exists("c.warnings", lambda w: w["message"].contains("casual")).alias("casual"))


def magnitude_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = validation.format_rules(Q.questions(table(spark, sf_dir, "documents")))
    n = lambda word: F.size(F.filter("f.warnings", lambda w: w["message"].startswith(f"Very {word} number"))).cast("long")
    return f.select("id", n("large").alias("n_large"), n("small").alias("n_small"))


def common_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Q.responses(table(spark, sf_dir, "documents")).select(parsing.parse(F.col("response")).alias("r")).select(F.col("r.error").alias("error"))
    # counted, not filtered, by error: a filter on the key would go below the aggregate and parse every text again
    return r.groupBy("error").agg(F.count("error").alias("n")).filter("n > 0").orderBy(F.desc("n"), "error").limit(5)


_SPAN = "RANGE BETWEEN INTERVAL '{}' SECOND PRECEDING AND INTERVAL '1' MICROSECOND PRECEDING".format
_FB = ", ".join(f"('{t}', {k}, '{q.replace(chr(39), chr(39) * 2)}', '{'|'.join(o)}', '{a}')" for t, k, q, o, a in dims.FALLBACKS)
_MD5 = "md5({})".format
_STEPS = "This is an AI-generated long-answer question.|Approach this systematically by identifying given values,|selecting appropriate physics equations,|substituting values carefully,|and presenting your solution clearly with proper units."
_THREE = ", ".join(f"('{t}', '{d.replace(chr(39), chr(39) * 2)}')" for t, d, _, _ in TOPICS)
ORACLES = {
    "rate_limit_admission": f"""WITH {USAGE_SQL},
w AS (SELECT *, count(*) OVER m AS n_minute, coalesce(sum(tokens) OVER m, 0) AS tm, count(*) OVER d AS n_day, coalesce(sum(tokens) OVER d, 0) AS td, coalesce(sum(cost) OVER d, 0) AS cd FROM use
  WINDOW m AS (PARTITION BY api_type ORDER BY ts {_SPAN(60)}), d AS (PARTITION BY api_type ORDER BY ts {_SPAN(86400)}))
SELECT id, api_type, CASE WHEN cd >= day_cost::DECIMAL(20, 10) THEN 'reject_cost' WHEN n_day >= rpd THEN 'reject_requests' WHEN td >= tpd THEN 'reject_tokens' WHEN n_minute >= rpm THEN 'delay' WHEN tm >= tpm THEN 'delay_tokens' ELSE 'admit' END AS decision,
  n_minute::BIGINT AS n_minute, n_day::BIGINT AS n_day, td::BIGINT AS tokens_day, cd::DOUBLE AS cost_day FROM w""",
    "retry_budget": f"""WITH {_ERRORS_SQL},
w AS (SELECT id, error_type, count(*) OVER (PARTITION BY error_type ORDER BY ts {_SPAN(300)}) AS n FROM err)
SELECT id, error_type, n::BIGINT AS n, error_type NOT IN ('configuration_error', 'api_limit') AND n < CASE WHEN error_type = 'llama_failure' THEN 3 ELSE 2 END AS retry FROM w""",
    "chunks_of_three": f"WITH {_EVENTS_SQL} SELECT id, ((row_number() OVER (PARTITION BY topic ORDER BY ts, id) - 1) // 3)::BIGINT AS chunk FROM ev",
    "history_numbers": f"""WITH {_EVENTS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM ev)
SELECT user_id::BIGINT AS user_id, id, 'Q' || k || ': ' || array_to_string(list_transform(string_split(topic, '-'), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM h WHERE r <= 5""",
    "attempt_numbers": f"""WITH {_EVENTS_SQL}, a AS (SELECT id, row_number() OVER (PARTITION BY user_id, topic, ts::DATE ORDER BY ts, id) AS attempt FROM ev)
SELECT id, attempt::BIGINT AS attempt, attempt <= 2 AS again, CASE WHEN attempt >= 5 THEN 10000 ELSE (1000 * pow(2, attempt - 1))::BIGINT END AS delay_ms FROM a""",
    "session_stats": f"WITH {_EVENTS_SQL} SELECT user_id::BIGINT AS user_id, count(*)::BIGINT AS n, sum(ms)::BIGINT AS total_ms, (list(ms ORDER BY ts DESC, id DESC))[1] AS last_ms, least(count(*), 5)::BIGINT AS history FROM ev GROUP BY user_id",
    "parse_refined": f"WITH {_REFINED_SQL} SELECT id, md5(rt) AS question_md5, array_to_string(rop, '|') AS options, ra AS answer, array_to_string(imp, '|') AS improvements FROM rr",
    "final_question": f"""WITH {_REFINED_SQL} SELECT id, topic, md5(CASE WHEN id % 4 = 1 OR id % 9 = 2 THEN t ELSE rt END) AS question_md5, array_to_string(CASE WHEN id % 4 = 1 OR id % 9 = 2 THEN o ELSE rop END, '|') AS options,
  CASE WHEN id % 4 = 1 OR id % 9 = 2 THEN answer ELSE ra END AS correct_answer, CASE WHEN id % 4 = 1 THEN 'Fallback question (OpenRouter API timeout). Original Llama-generated content.' WHEN id % 9 = 2 THEN 'Fallback question (Refinement disabled). Original Llama-generated content.'
    ELSE 'This question tests understanding of ' || topic || '.' || CASE WHEN id % 3 = 0 THEN '' ELSE ' Improvements made: shorter, well, formed, one, two' END END AS explanation,
  NOT (id % 4 = 1 OR id % 9 = 2) AS refinement_applied, CASE WHEN id % 2 = 0 THEN 'multiple-choice' ELSE 'long-answer' END AS type, 'standard' AS difficulty FROM rr""",
    "format_response": rf"""WITH {QUESTIONS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'mcq' ELSE 'long' END AS kind, display AS topic, md5(t) AS question_md5, CASE WHEN id % 2 = 0 THEN array_to_string(list_transform(o, lambda x: regexp_replace(x, '^[A-D]\)\s*', '')), '|') END AS options,
  CASE WHEN id % 2 = 0 THEN (instr('ABCDE', answer) - 1)::BIGINT END AS correct, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'One' || chr(10) || 'Two' ELSE 'One|Two' END
    WHEN id % 2 = 0 THEN 'This question was generated using AI and refined for accuracy.|The answer demonstrates proper application of IB Physics principles.|Topic: ' || display ELSE '{_STEPS}' END AS solution,
  CASE WHEN id % 2 = 1 THEN 'Topic: ' || display || ' - Advanced problem requiring detailed analysis and calculation.' WHEN id % 3 = 0 THEN 'Topic: ' || display || ' - Generated using advanced AI models trained on IB Physics curriculum.' ELSE 'Topic: ' || display || ' - One' || chr(10) || 'Two' END AS theory FROM q""",
    "fallback_pick": f"""WITH {QUESTIONS_SQL}, bank(topic, k, qt, op, a) AS (VALUES {_FB}), n AS (SELECT topic, count(*) AS c FROM bank GROUP BY topic)
SELECT id, q.topic, coalesce(qt, 'This is a fallback question for ' || q.topic || '. What is the correct answer?') AS question_text, coalesce(op, '{"|".join(dims.FALLBACK_OPTIONS)}') AS options, coalesce(a, 'A') AS correct_answer
FROM q LEFT JOIN n ON q.topic = n.topic LEFT JOIN bank b ON b.topic = q.topic AND b.k = q.id % n.c""",
    "request_validation": f"""WITH {QUESTIONS_SQL} SELECT id, id % 9 IN (0, 1, 6, 7) AS valid, CASE id % 9 WHEN 2 THEN 'Difficulty must be "standard" or "higher"' WHEN 3 THEN 'Type must be "multiple-choice" or "long-answer"' WHEN 4 THEN 'Topic is required' WHEN 5 THEN 'Invalid topic. Must be one of: ' || (SELECT string_agg(topic, ', ' ORDER BY ord) FROM topics) WHEN 8 THEN 'Invalid request body' END AS error,
  CASE id % 9 WHEN 0 THEN topic WHEN 1 THEN topic WHEN 6 THEN CASE id % 4 WHEN 1 THEN 'wave-model' WHEN 2 THEN 'thermal-energy-transfers' ELSE 'kinematics' END WHEN 7 THEN 'kinematics' END AS topic,
  CASE id % 9 WHEN 0 THEN 'standard' WHEN 1 THEN 'higher' WHEN 6 THEN 'standard' WHEN 7 THEN 'standard' END AS difficulty, CASE id % 9 WHEN 0 THEN 'multiple-choice' WHEN 1 THEN 'long-answer' WHEN 6 THEN 'multiple-choice' WHEN 7 THEN 'long-answer' END AS type FROM q""",
    "error_normalisation": """WITH e AS (SELECT event_id AS id, ['llama', 'openrouter', 'refinement', 'validation', ''][event_id % 5 + 1] AS stage, CASE WHEN event_id % 7 <> 0 THEN ['request timeout', 'quota reached', 'rate limit', 'socket closed', '401 Unauthorized', 'API key not valid'][user_id % 6 + 1] END AS m FROM events)
SELECT id, CASE WHEN stage IN ('openrouter', 'refinement') THEN 'openrouter_failure' WHEN stage = 'validation' THEN 'validation_failure' WHEN m IN ('quota reached', 'rate limit') THEN 'api_limit' ELSE 'llama_failure' END AS error_type,
  'Generation failed at ' || stage || ': ' || coalesce(m, 'Unknown error') AS text, NOT (stage IN ('llama', '') AND coalesce(m IN ('quota reached', 'rate limit'), false)) AS retryable, coalesce(m IN ('401 Unauthorized', 'API key not valid'), false) AS abort FROM e""",
    "error_to_status": "SELECT doc_id, CASE WHEN regexp_matches(text, 'quota|limit') THEN 429 WHEN text LIKE '%timeout%' THEN 408 WHEN text LIKE '%validation%' THEN 422 ELSE 500 END::BIGINT AS status, CASE WHEN regexp_matches(text, 'quota|limit') THEN 'QUOTA_EXCEEDED' WHEN text LIKE '%timeout%' THEN 'TIMEOUT' WHEN text LIKE '%validation%' THEN 'VALIDATION_FAILED' ELSE 'GENERATION_FAILED' END AS code FROM documents",
    "outcome_errors": f"WITH {_EVENTS_SQL} SELECT ts::DATE::VARCHAR AS day, topic, CASE WHEN sum(success::INT) = 0 THEN 'all failed' ELSE 'some passed' END AS outcome, sum(success::INT)::BIGINT AS kept, (count(*) - sum(success::INT))::BIGINT AS dropped FROM ev GROUP BY 1, 2",
    "sanity_check": f"WITH {QUESTIONS_SQL} SELECT id, length(t) >= 10 AND len(o) = 4 AND answer <> 'E' AND id % 20 >= 2 AS sane FROM q",
    "json_envelope": "SELECT doc_id, text AS content FROM documents WHERE doc_id IS NOT NULL AND coalesce(text, '') <> '' UNION ALL SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{\"results\":[{\"text\":\"\"}]}' WHEN 1 THEN '{\"generated_text\":\"\"}' WHEN 2 THEN '{\"output\":[{\"text\":\"\"}]}' WHEN 3 THEN '{\"output\":[{\"generated_text\":\"\"}]}' WHEN 4 THEN '{\"data\":[{\"text\":\"\"}]}' END FROM documents WHERE doc_id IS NOT NULL AND coalesce(text, '') = ''",
    "json_tail": f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{{}}', '()') AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN trim(t, {_BLANKS}) = '' THEN NULL ELSE trim(t, {_BLANKS}) END WHEN 1 THEN 'inner' WHEN 2 THEN trim(t, {_BLANKS}) ELSE t END AS tail FROM d""",
    "text_download": f"""WITH {QUESTIONS_SQL} SELECT id, md5('Topic: ' || topic || chr(10) || chr(10) || 'Question: ' || t || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(o, lambda x, i: chr(64 + i::INT) || ') ' || x || chr(10)), '')
  || chr(10) || 'Correct Answer: ' || answer || chr(10) || chr(10)) AS text_md5, 'physics-question-' || replace(lower(display), ' ', '-') || '.txt' AS file, array_to_string(list_transform(string_split(topic, '-'), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM q""",
    "telemetry_export": f"""WITH {USAGE_SQL}, newest AS (SELECT string_agg(event_id, ',' ORDER BY ts, event_id) AS x FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10))
SELECT '{{"generations":{{"n":' || (SELECT count(*) FROM events) || ',"ok":' || (SELECT count(*) FROM events WHERE event_type <> 'error') || '}},"costs":{{"tokens":' || sum(tokens) || ',"cost":"' || sum(cost)::DECIMAL(18, 6) || '"}},"newest":"' || (SELECT x FROM newest) || '"}}' AS document FROM use""",
    "generate_batch": f"WITH {QUESTIONS_SQL} SELECT id, 'ok' AS status, 'offline' AS provider, 1::BIGINT AS attempts, 'What is central to ' || display || '?' AS question_text, 'B' AS answer, CASE WHEN contains(display, 'zzz') THEN 1.0 ELSE 0.8 END AS confidence FROM q",
    "cost_estimates": f"""WITH {USAGE_SQL}, k AS (SELECT CASE operation WHEN 'purchase' THEN 'batchGeneration' WHEN 'view' THEN 'validation' ELSE 'questionGeneration' END AS kind, cost FROM use)
SELECT kind, count(*)::BIGINT AS n, round(sum(cost)::DOUBLE, 8) AS cost, round(count(*) * CASE kind WHEN 'batchGeneration' THEN 0.0008 WHEN 'validation' THEN 0.00002 ELSE 0.0001 END, 8)::DOUBLE AS estimated FROM k GROUP BY kind""",
    "settings_merge": "SELECT event_id AS id, 'litUrl=http://' || event_type || ';llamaModelId=' || user_id || ';theme=dark' AS settings FROM events",
    "record_ids": f"SELECT event_id AS id, 'metric-' || {_MS('ts')} || '-' || substr(sha256({_MS('ts')} || '|' || event_id || '|' || event_type), 1, 9) AS record_id FROM events",
    "running_totals": f"""WITH {USAGE_SQL}, m AS (SELECT *, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS keep FROM use)
SELECT api_type, count(*) FILTER (WHERE keep)::BIGINT AS n, coalesce(sum(tokens) FILTER (WHERE keep), 0)::BIGINT AS tokens, coalesce(round(sum(cost) FILTER (WHERE keep)::DOUBLE, 8), 0) AS cost, count(*) FILTER (WHERE NOT keep)::BIGINT AS removed FROM m GROUP BY api_type""",
    "audit_rollup": _lin(f"WITH {_CONTRAST_SQL}") + " SELECT page, theme, count(*)::BIGINT AS checked, count(*) FILTER (WHERE ratio < 4.5)::BIGINT AS fail45, count(*) FILTER (WHERE ratio < 3)::BIGINT AS fail30 FROM r GROUP BY page, theme",
    "audit_worst_12": _lin(f"WITH {_CONTRAST_SQL}") + " SELECT event_id, page, theme, round(ratio, 2) AS ratio FROM r WHERE ratio < 4.5 ORDER BY r.ratio, event_id LIMIT 12",
    "difficulty_class": f"WITH {QUESTIONS_SQL},\n{Q.COMPLIANCE_SQL} SELECT id, topic, difficulty FROM com",
    "topic_relevance": f"WITH {QUESTIONS_SQL},\n{Q.COMPLIANCE_SQL} SELECT id, topic, round(r, 6) AS relevance, r < 0.5 AS warned, r < 0.3 AS suggested FROM com",
    "style_rules": f"WITH {QUESTIONS_SQL},\n{Q.COMPLIANCE_SQL} SELECT id, array_to_string(list_filter(suggestions, lambda x: NOT starts_with(x, 'Consider focusing')), '|') AS suggestions, list_contains(warnings, 'Question uses casual language not typical of IB Physics') AS casual FROM com",
    "magnitude_validation": f"WITH {QUESTIONS_SQL} SELECT id, len(list_filter(regexp_extract_all(t, '[0-9]+[.]?[0-9]*'), lambda x: x::DOUBLE > 1e10))::BIGINT AS n_large, len(list_filter(regexp_extract_all(t, '[0-9]+[.]?[0-9]*'), lambda x: x::DOUBLE > 0 AND x::DOUBLE < 1e-6))::BIGINT AS n_small FROM q",
    "common_parse_errors": f"WITH {Q.RESPONSES_SQL},\n{Q.PARSED_SQL} SELECT error, count(*)::BIGINT AS n FROM parsed WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error LIMIT 5",
    "parse_lines": rf"""WITH {Q.RESPONSES_SQL}, b2 AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(replace(replace(b, chr(13), chr(10)), chr(10) || ' C. ', chr(10) || 'C) '), '^ C\. ', 'C) '), chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS ls, id % 12 = 4 AS wrapped FROM bodies WHERE id % 12 <> 4),
k AS (SELECT id, ls, list_filter(ls, lambda x: regexp_matches(x, '^[ABCD]\)')) AS op, list_filter(ls, lambda x: regexp_matches(x, '(?i)^(ANSWER|CORRECT):')) AS an FROM b2),
z AS (SELECT id, list_transform(op, lambda x: trim(substr(x, 3), {_BLANKS})) AS o, array_to_string(list_filter(ls[1:CASE WHEN len(op) = 0 THEN len(ls) ELSE list_position(ls, op[1]) - 1 END], lambda x: NOT regexp_matches(x, '(?i)^(ANSWER|CORRECT):')), ' ') AS q,
  list_filter(list_transform(an, lambda x: regexp_extract(upper(x), ':[^ABCD]*([ABCD])', 1)), lambda x: x <> '')[-1] AS a FROM k),
g AS (SELECT id, q, o, a, q <> '' AND len(o) = 4 AND a IS NOT NULL AS good FROM z)
SELECT id, CASE WHEN good THEN length(q) END::BIGINT AS question_chars, CASE WHEN good THEN array_to_string(o, '|') END AS options, CASE WHEN good THEN a END AS answer, CASE WHEN good THEN 0.8 END::DOUBLE AS confidence FROM g
UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM bodies WHERE id % 12 = 4""",
    "parse_json_object": f"""WITH {QUESTIONS_SQL}, n AS (SELECT q.id, text IS NULL AS none, t, o, answer, q.id % 6 <> 0 AND len(o) = 4 AND answer <> 'E' AND text IS NOT NULL AS good FROM q JOIN documents d ON d.doc_id = q.id)
SELECT id, CASE WHEN good THEN t END AS question, CASE WHEN good THEN 4 END::BIGINT AS n_options, CASE WHEN good THEN answer END AS answer FROM n""",
    "parse_options_section": rf"""WITH {QUESTIONS_SQL}, x AS (SELECT id, answer, chr(10) || array_to_string(list_transform(o, lambda x: translate(x, chr(10) || chr(13), '  ')), chr(10)) AS s FROM q),
m AS (SELECT id, answer, regexp_extract_all(regexp_replace(s, '\n([A-D]\))', chr(1) || chr(10) || '\1', 'g') || chr(1), '([A-D]\)(?:{_W}|\x01)*[^\n\r\x01]+?)\x01', 1) AS o FROM x),
g AS (SELECT id, o, answer, len(o) = 4 AND answer <> 'E' AND id % 2 = 0 AS good FROM m)
SELECT id, CASE WHEN good THEN 'Which one holds?' END AS question_text, CASE WHEN good THEN array_to_string(list_transform(o, lambda x: substr(x, 1, 2) || ' ' || trim(substr(x, 3), {_BLANKS})), '|') END AS options, CASE WHEN good THEN answer END AS answer FROM g""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
