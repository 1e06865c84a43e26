"""Settings, limits, prompts and projections as the logs ask for them; expected SQL is written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strings, told
from ..functions.dims import ENVIRONMENTS, LEGACY_TOPICS, LIMITS, MODEL_SETTINGS, TOPICS, values
from ..operators import records
from ..sources.tables import table
from . import questions as Q
from .questions import QUESTIONS_SQL, _joined
from .records import USAGE_SQL, _limits, _usage

#: Names of topics as requests have them, and environments with the variables that they set.
ALIASES = [*LEGACY_TOPICS, "Mechanics", "ELECTRICITY", "unknown"]
NAMED = [("production", "15", "7.5"), ("test", "", "abc"), ("development", None, "0"), ("other", "9", None)]
MODELS = [*(f"owner/{m}" for m, *_ in MODEL_SETTINGS), "other-model"]
_INSTRUCTION = "Generate an IB Physics Paper 1 style multiple-choice question."
_K_SQL = "json_extract_string(props, '$.k')::BIGINT"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _pick(options: list, by: Column) -> Column:
    return F.get(strings(options), F.pmod(by, F.lit(len(options))).cast("int"))


def legacy_topic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic that each request of the log means by an older name; kinematics where it is not known."""
    dim = F.create_map(*[F.lit(x) for kv in LEGACY_TOPICS.items() for x in kv])
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _pick(ALIASES, F.col("user_id")).alias("alias"))
    return e.select("id", "alias", F.coalesce(dim[F.lower("alias")], F.lit("kinematics")).alias("topic"))


def prompt_errors(prompt: Column) -> Column:
    """What a prompt lacks, in order."""
    n = F.length(prompt)
    return told(
        (~prompt.contains("TOPIC:"), F.lit("Missing topic specification")),
        (~prompt.contains("DIFFICULTY:"), F.lit("Missing difficulty level")),
        (~prompt.contains("FORMAT YOUR RESPONSE"), F.lit("Missing format instructions")),
        (n < 200, F.lit("Prompt too short - may lack sufficient context")),
        (n > 2000, F.lit("Prompt too long - may exceed model context limits")),
    )


def prompt_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question, what its stored record looks like, and what the rules say of a prompt that quotes it."""
    rows = spark.createDataFrame([(t, d) for t, d, _, _ in TOPICS], "topic string, display string")
    q = Q.questions(table(spark, sf_dir, "documents")).join(F.broadcast(rows), "topic")
    row = lambda out: F.to_json(F.struct(F.lit(_INSTRUCTION).alias("instruction"), F.concat(F.lit("Topic: "), "display").alias("input"), out.alias("output")))
    text = F.coalesce("question_text", F.lit(""))
    head = F.concat(F.when(F.col("id") % 2 == 0, "TOPIC: x ").otherwise(""), F.when(F.col("id") % 3 == 0, "DIFFICULTY: y ").otherwise(""), F.when(F.col("id") % 5 == 0, "FORMAT YOUR RESPONSE ").otherwise(""))
    kept = F.get_json_object(row(text), "$.output")
    return q.select("id", row(F.lit("")).alias("prompt"), F.md5(F.coalesce(kept, F.lit("")).cast("binary")).alias("output_md5"), _joined(prompt_errors(F.concat(head, text))).alias("errors"))


def limit_errors(rpm: Column, rpd: Column, tpm: Column, tpd: Column, price: Column, most: Column) -> Column:
    """What is wrong with limits, in order."""
    return told(
        (rpm <= 0, F.lit("requestsPerMinute must be positive")), (rpd <= 0, F.lit("requestsPerDay must be positive")),
        (tpm <= 0, F.lit("tokensPerMinute must be positive")), (tpd <= 0, F.lit("tokensPerDay must be positive")),
        (price < 0, F.lit("costPerToken cannot be negative")), (most <= 0, F.lit("maxDailyCost must be positive")),
        (rpm * 1440 < rpd, F.lit("requestsPerDay exceeds theoretical maximum based on requestsPerMinute")),
        (tpm * 1440 < tpd, F.lit("tokensPerDay exceeds theoretical maximum based on tokensPerMinute")),
    )


def config_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that the log sets, event by event, and what the rules say of them."""
    u, k = F.col("user_id"), _k()
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (k % 7 - 1).alias("rpm"), (u % 9 * 500 - 400).alias("rpd"), (k % 5 * 10).alias("tpm"), (u % 4 * 20_000).alias("tpd"), (k % 11 - 1).alias("price"), (u % 6).alias("most")
    )
    rules = limit_errors(*[F.col(c) for c in ("rpm", "rpd", "tpm", "tpd", "price", "most")])
    return e.select("id", (F.size(rules) == 0).alias("valid"), _joined(rules).alias("errors"))


def model_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each request: of its environment, replaced by those of its model, then by its own; and whether they are allowed."""
    env = spark.createDataFrame(ENVIRONMENTS, "environment string, retries int, timeout_ms int, e_temperature double, e_tokens int")
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), _pick([x[0] for x in ENVIRONMENTS], F.col("user_id")).alias("environment"), _pick(MODELS, F.col("event_id")).alias("model_id"),
        F.when(_k() % 4 == 0, _k() / 20.0).alias("own_temperature"), F.when(_k() % 3 == 0, _k() * 40).alias("own_tokens"),
    )
    e = records.model_settings(e.join(F.broadcast(env), "environment"))
    t, m, p = F.coalesce("own_temperature", "temperature", "e_temperature"), F.coalesce("own_tokens", "max_tokens", "e_tokens"), F.coalesce("top_p", F.lit(0.9))
    ok = F.col("retries").between(1, 10) & F.col("timeout_ms").between(5000, 120000) & t.between(0, 2) & m.between(100, 2000) & p.between(0.1, 1.0)
    return e.select("id", "environment", "model_id", F.col("retries").cast("long").alias("retries"), t.alias("temperature"), m.cast("long").alias("max_tokens"), p.alias("top_p"), ok.alias("valid"))


def env_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of each request: of the profile of its environment, with numbers from variables where they are numbers."""
    names = spark.createDataFrame(NAMED, "environment string, rpm_var string, cost_var string")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _pick([n[0] for n in NAMED], F.col("user_id")).alias("environment"), F.when(_k() % 5 == 0, _k().cast("string")).alias("own"))
    profile = F.when(F.col("environment") == "production", "production").when(F.col("environment") == "development", "development").when(F.col("environment") == "test", "testing").otherwise("default")
    e = e.join(F.broadcast(names), "environment").withColumn("profile", profile).join(F.broadcast(_limits(spark)), "profile")
    number = lambda c, kind: F.expr(f"try_cast(nullif({c}, '') AS {kind})")
    rpm = F.coalesce(number("own", "INT"), number("rpm_var", "INT"), F.col("rpm"))
    return e.select("id", "environment", "profile", "api_type", rpm.cast("long").alias("rpm"), F.coalesce(number("cost_var", "DOUBLE"), F.col("day_cost").cast("double")).alias("day_cost"))


def usage_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of each user by how much it asks for: those of the pattern's profile, merged with the pattern's own daily costs."""
    own = [("light", "development", "0.25"), ("medium", "default", "1.50"), ("heavy", "production", "7.50")]
    n = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("pattern", F.when(F.col("n") < 60, "light").when(F.col("n") < 75, "medium").otherwise("heavy"))
    p = spark.createDataFrame(own, "pattern string, profile string, hf string").join(F.broadcast(_limits(spark)), "profile")
    cols = records.merged({"day_cost": F.col("day_cost")}, {"day_cost": F.when(F.col("api_type") == "huggingface", F.col("hf"))})
    p = p.select("pattern", "api_type", F.col("rpm").cast("long").alias("rpm"), F.col("rpd").cast("long").alias("rpd"), cols["day_cost"].cast("double").alias("day_cost"))
    return n.join(F.broadcast(p), "pattern").select("user_id", "n", "pattern", "api_type", "rpm", "rpd", "day_cost")


def monthly_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month at the tokens that the log has a day, at each profile's prices, against thirty daily budgets."""
    days = table(spark, sf_dir, "events").agg(F.countDistinct(F.to_date("ts")).alias("days"))
    u = _usage(spark, sf_dir).groupBy("api_type").agg(F.sum("tokens").alias("tokens")).crossJoin(F.broadcast(days))  # one row
    own = u.join(F.broadcast(_limits(spark)), "api_type")
    month = F.floor(F.col("tokens") * 30 / F.col("days"))
    own = own.select("profile", "api_type", (month.cast("decimal(20,0)") * F.col("token_cost").cast("decimal(10,7)")).alias("cost"), (F.col("day_cost").cast("decimal(10,2)") * 30).alias("budget"))
    by = own.groupBy("profile").agg(*[F.sum(F.when(F.col("api_type") == a, F.col("cost"))).alias(a) for a in ("openrouter", "huggingface")], F.sum("cost").alias("total"), F.sum("budget").alias("budget"))
    return by.select("profile", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("openrouter", "huggingface", "total")], (F.col("total") <= F.col("budget")).alias("within_budget"))


_LIM = f"l(profile, api_type, rpm, rpd, tpm, tpd, token_cost, day_cost) AS ({values(LIMITS)})"
_RULES = [
    ("rpm <= 0", "requestsPerMinute must be positive"), ("rpd <= 0", "requestsPerDay must be positive"), ("tpm <= 0", "tokensPerMinute must be positive"), ("tpd <= 0", "tokensPerDay must be positive"),
    ("price < 0", "costPerToken cannot be negative"), ("most <= 0", "maxDailyCost must be positive"), ("rpd > rpm * 1440", "requestsPerDay exceeds theoretical maximum based on requestsPerMinute"),
    ("tpd > tpm * 1440", "tokensPerDay exceeds theoretical maximum based on tokensPerMinute"),
]
_PROMPT = [
    ("NOT contains(p, 'TOPIC:')", "Missing topic specification"), ("NOT contains(p, 'DIFFICULTY:')", "Missing difficulty level"), ("NOT contains(p, 'FORMAT YOUR RESPONSE')", "Missing format instructions"),
    ("length(p) <= 199", "Prompt too short - may lack sufficient context"), ("length(p) >= 2001", "Prompt too long - may exceed model context limits"),
]
_all = lambda rules: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rules) + "], lambda x: x IS NOT NULL), '|')"

ORACLES: dict[str, str] = {
    "legacy_topic_map": "WITH a(i, alias, topic) AS (VALUES "
    + ", ".join(f"({i}, '{a}', '{LEGACY_TOPICS.get(a.lower(), 'kinematics')}')" for i, a in enumerate(ALIASES))
    + f") SELECT event_id AS id, alias, topic FROM events JOIN a ON i = user_id % {len(ALIASES)}",
    "prompt_json": f"""WITH {QUESTIONS_SQL},
s AS (SELECT id, display, t, CASE WHEN id % 2 = 0 THEN 'TOPIC: x ' ELSE '' END || CASE WHEN id % 3 = 0 THEN 'DIFFICULTY: y ' ELSE '' END || CASE WHEN id % 5 = 0 THEN 'FORMAT YOUR RESPONSE ' ELSE '' END || t AS p FROM q)
SELECT id, '{{"instruction":"{_INSTRUCTION}","input":"Topic: ' || display || '","output":""}}' AS prompt, md5(t) AS output_md5, {_all(_PROMPT)} AS errors FROM s""",
    "config_check": f"""WITH c AS (SELECT event_id AS id, {_K_SQL} % 7 - 1 AS rpm, user_id % 9 * 500 - 400 AS rpd, {_K_SQL} % 5 * 10 AS tpm, user_id % 4 * 20000 AS tpd, {_K_SQL} % 11 - 1 AS price, user_id % 6 AS most FROM events),
r AS (SELECT id, {_all(_RULES)} AS errors FROM c) SELECT id, errors = '' AS valid, errors FROM r""",
    "model_config": f"""WITH e(i, environment, retries, timeout_ms, t, m) AS (VALUES {", ".join(f"({i}, '{e[0]}', {e[1]}, {e[2]}, {e[3]}, {e[4]})" for i, e in enumerate(ENVIRONMENTS))}),
s(j, model_id, t2, m2, p2) AS (VALUES {", ".join(f"({j}, 'owner/{x[0]}', {x[1]}, {x[2]}, {x[3]})" for j, x in enumerate(MODEL_SETTINGS))}, ({len(MODEL_SETTINGS)}, 'other-model', NULL, NULL, NULL)),
k AS (SELECT event_id AS id, {_K_SQL} AS k, e.*, s.* FROM events JOIN e ON e.i = user_id % {len(ENVIRONMENTS)} JOIN s ON s.j = event_id % {len(MODELS)}),
v AS (SELECT *, coalesce(CASE WHEN k % 4 = 0 THEN k / 20.0 END, t2, t)::DOUBLE AS temperature, coalesce(CASE WHEN k % 3 = 0 THEN k * 40 END, m2, m)::BIGINT AS max_tokens FROM k)
SELECT id, environment, model_id, retries::BIGINT AS retries, temperature, max_tokens, coalesce(p2, 0.9)::DOUBLE AS top_p, NOT (temperature < 0 OR temperature > 2 OR max_tokens < 100 OR max_tokens > 2000) AS valid FROM v""",
    "env_config": f"""WITH {_LIM}, n(i, environment, profile, r, c) AS (VALUES (0, 'production', 'production', 15, 7.5), (1, 'test', 'testing', NULL, NULL), (2, 'development', 'development', NULL, 0), (3, 'other', 'default', 9, NULL))
SELECT event_id AS id, environment, n.profile, api_type, coalesce(CASE WHEN {_K_SQL} % 5 = 0 THEN {_K_SQL} END, r, rpm)::BIGINT AS rpm, coalesce(c::DOUBLE, day_cost::DOUBLE) AS day_cost FROM events JOIN n ON n.i = user_id % 4 JOIN l ON l.profile = n.profile""",
    "usage_patterns": f"""WITH {_LIM}, u AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1),
p AS (SELECT *, CASE WHEN n >= 75 THEN 'heavy' WHEN n >= 60 THEN 'medium' ELSE 'light' END AS pattern FROM u),
c(pattern, profile, cost) AS (VALUES ('light', 'development', 0.25), ('medium', 'default', 1.5), ('heavy', 'production', 7.5))
SELECT p.user_id::BIGINT AS user_id, n::BIGINT AS n, pattern, api_type, rpm::BIGINT AS rpm, rpd::BIGINT AS rpd, CASE api_type WHEN 'openrouter' THEN 0 ELSE cost END::DOUBLE AS day_cost FROM p JOIN c USING (pattern) JOIN l USING (profile)""",
    "monthly_projection": f"""WITH {USAGE_SQL}, {_LIM}, d AS (SELECT count(DISTINCT ts::DATE) AS days FROM events), t AS (SELECT api_type, sum(tokens) AS tokens FROM use GROUP BY 1),
c AS (SELECT l.profile, l.api_type, floor(tokens * 30 / days)::DECIMAL(20, 0) * l.token_cost::DECIMAL(10, 7) AS cost, 30 * l.day_cost::DECIMAL(10, 2) AS budget FROM l JOIN t USING (api_type), d)
SELECT profile, round(max(cost) FILTER (WHERE api_type = 'openrouter')::DOUBLE, 6) AS openrouter, round(max(cost) FILTER (WHERE api_type = 'huggingface')::DOUBLE, 6) AS huggingface, round(sum(cost)::DOUBLE, 6) AS total, sum(cost) <= sum(budget) AS within_budget FROM c GROUP BY profile""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
