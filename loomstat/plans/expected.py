"""Expected SQL of the queries of ``registry``, written from their rules and not from their texts."""

from __future__ import annotations

from ..functions.dims import CATEGORIES, LIMITS, METERED, RECOVERY, RECOVERY_DEFAULT, TOPICS
from .records import _ERRORS_SQL, _EVENTS_SQL, USAGE_SQL


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOW = "(SELECT max(ts) FROM events)"
_PAGE = f"{_EVENTS_SQL}, {_ERRORS_SQL}"
_SINCE = "{} - ts <= INTERVAL {}".format
_DAY = _SINCE(_NOW, "1 DAY")
_SHARE = "round(count(*) FILTER (WHERE success)::DOUBLE / count(*), 6)"
_MEAN = "round(avg(ms) FILTER (WHERE success), 6)"
_MONEY = "round(sum(cost)::DOUBLE, 8)"


def _budgets(profile: str) -> str:
    """Limits of a profile as rows, those of its APIs."""
    rows = ", ".join(f"({_quoted(a)}, {rpd}, {tpd}, {_quoted(c)})" for p, a, _, rpd, _, tpd, _, c in LIMITS if p == profile)
    return f"lim(api_type, rpd, tpd, day_cost) AS (VALUES {rows})"


def _health(minutes: int) -> str:
    since = _SINCE(_NOW, f"{minutes} MINUTE")
    return f"""WITH {_PAGE},
g AS (SELECT count(*) AS n, count(*) FILTER (WHERE success) AS ok, avg(ms) FILTER (WHERE success) AS ms FROM ev WHERE {since}),
x AS (SELECT count(*) AS n, count(*) FILTER (WHERE error_type = 'api_limit') AS q FROM err WHERE {since}),
v AS (SELECT CASE WHEN g.n = 0 THEN 1 ELSE round(ok::DOUBLE / g.n, 6) END AS success_rate, coalesce(round(ms, 6), 0) AS avg_ms, CASE WHEN g.n = 0 THEN 0 ELSE round(x.n::DOUBLE / g.n, 6) END AS error_rate,
  CASE WHEN q >= 6 THEN 'critical' WHEN q >= 3 THEN 'warning' ELSE 'ok' END AS quota FROM g, x)
SELECT CASE WHEN quota = 'critical' OR NOT success_rate >= 0.5 OR NOT avg_ms <= 30000 THEN 'critical' WHEN quota <> 'ok' OR NOT (success_rate >= 0.8 AND avg_ms <= 15000 AND error_rate <= 0.1) THEN 'warning' ELSE 'healthy' END AS status,
  success_rate, avg_ms, error_rate, quota, array_to_string(list_filter([
    CASE WHEN success_rate < 0.8 THEN 'Low success rate: ' || round(success_rate * 100, 1)::DECIMAL(10, 1) || '%' END, CASE WHEN avg_ms > 20000 THEN 'High response time: ' || round(avg_ms / 1000, 1)::DECIMAL(10, 1) || 's' END,
    CASE WHEN error_rate > 0.2 THEN 'High error rate: ' || round(error_rate * 100, 1)::DECIMAL(10, 1) || '%' END,
    CASE WHEN quota = 'critical' THEN 'API quota limits reached' WHEN quota = 'warning' THEN 'API quota usage high' END], lambda s: s IS NOT NULL), '; ') AS alerts FROM v"""


_ADVICE = " ".join(f"WHEN {_quoted(k)} THEN {_quoted('; '.join(v))}" for k, v in RECOVERY.items())
_THEMES = {theme: category for theme, category in CATEGORIES}
_BY_API = ", ".join(_quoted(a) for a in dict.fromkeys(m[1] for m in METERED))

_CATALOG = (
    "(VALUES "
    + ", ".join(f"({i}, {_quoted(t)}, {_quoted(d)}, {_quoted(_THEMES.get(theme, 'Other'))}, {str(bool(hl)).lower()}, {str(theme == 'O').lower()})" for i, (t, d, theme, hl) in enumerate(TOPICS))
    + ") v(ord, topic, display, category, hl, optional)"
)
ORACLES: dict[str, str] = {
    "topic_analysis": f"""WITH {_EVENTS_SQL}, {_ERRORS_SQL},
c AS (SELECT t.topic, error_type, count(*) AS n, min(ts) AS since FROM err JOIN topics t ON t.ord = user_id % 29 GROUP BY ALL),
k AS (SELECT topic, array_to_string(list(error_type ORDER BY n DESC, since, error_type)[1:3], ',') AS common FROM c GROUP BY 1),
m AS (SELECT topic, count(*) AS n, {_SHARE} AS rate, {_MEAN} AS ms FROM ev GROUP BY 1),
a AS (SELECT t.topic, t.display, coalesce(n, 0)::BIGINT AS attempts, coalesce(rate, 0) AS success_rate, coalesce(ms, 0) AS avg_ms, coalesce(common, '') AS common_errors FROM topics t LEFT JOIN m USING (topic) LEFT JOIN k USING (topic))
SELECT *, CASE WHEN NOT success_rate >= 0.7 THEN 'High failure rate - check model training for this topic' WHEN avg_ms > 25000 THEN 'Slow generation - consider optimizing prompts'
  WHEN contains(common_errors, 'validation_failure') THEN 'Validation issues - review question format requirements' ELSE 'Performance is good' END AS recommendation FROM a""",
    "metrics_summary": f"WITH {_EVENTS_SQL} SELECT count(*)::BIGINT AS total, coalesce({_SHARE}, 0) AS success_rate, coalesce({_MEAN}, 0) AS avg_ms FROM ev WHERE {_DAY}",
    "errors_by_type": f"WITH {_ERRORS_SQL} SELECT error_type, count(*)::BIGINT AS n FROM err WHERE {_DAY} GROUP BY ALL",
    "generations_by_topic": f"WITH {_EVENTS_SQL} SELECT topic, count(*)::BIGINT AS n FROM ev WHERE {_DAY} GROUP BY ALL",
    "avg_time_by_topic": f"WITH {_EVENTS_SQL} SELECT topic, round(sum(ms)::DOUBLE / count(ms), 6) AS avg_ms FROM ev WHERE success AND {_DAY} GROUP BY ALL",
    "hourly_stats": f"""WITH {_EVENTS_SQL}, d AS (SELECT strftime(ts, '%H') AS h, * FROM ev WHERE {_DAY})
SELECT printf('%02d', r.h) AS hour_of_day, count(d.id)::BIGINT AS generations, count(*) FILTER (WHERE success)::BIGINT AS successes, coalesce(round(avg(ms) FILTER (WHERE success), 6), 0) AS avg_ms FROM range(24) r(h) LEFT JOIN d ON d.h = printf('%02d', r.h) GROUP BY r.h""",
    "health_indicators": _health(15),
    "health_indicators_24h": _health(1440),
    "error_patterns": f"WITH {_ERRORS_SQL}, r AS (SELECT error_type, count(*) AS n FROM err WHERE {_DAY} GROUP BY 1 HAVING count(*) >= 6) SELECT error_type, n::BIGINT AS n, (SELECT sum(n) FROM r) >= 11 AS spike FROM r",
    "error_patterns_10m": f"WITH {_ERRORS_SQL} SELECT error_type, count(*)::BIGINT AS n FROM err WHERE {_SINCE(_NOW, '10 MINUTE')} GROUP BY 1 HAVING count(*) >= 6",
    "recent_errors_by_type": f"WITH {_ERRORS_SQL} SELECT error_type, count(*)::BIGINT AS n FROM err WHERE {_SINCE(_NOW, '5 MINUTE')} GROUP BY ALL",
    "retention_newest_n": f"WITH {_EVENTS_SQL} SELECT id, topic, success, ms FROM ev QUALIFY row_number() OVER (ORDER BY ts DESC, id) <= 1000",
    "cost_by_operation": f"WITH {USAGE_SQL} SELECT operation, {_MONEY} AS cost, count(*)::BIGINT AS n, round(sum(cost)::DOUBLE / count(*), 10) AS avg_cost FROM use WHERE {_DAY} GROUP BY ALL",
    "cost_by_api": f"WITH {USAGE_SQL} SELECT api_type, {_MONEY} AS cost FROM use WHERE {_DAY} GROUP BY ALL",
    "cost_by_hour": f"WITH {USAGE_SQL} SELECT strftime(ts, '%H') AS hour_of_day, {_MONEY} AS cost FROM use WHERE {_DAY} GROUP BY 1",
    "cost_breakdown_rollup": f"""WITH {USAGE_SQL} SELECT api_type, operation, {_MONEY} AS cost, count(*)::BIGINT AS n FROM use GROUP BY 1, 2
UNION ALL SELECT api_type, NULL, {_MONEY}, count(*)::BIGINT FROM use GROUP BY 1 UNION ALL SELECT NULL, NULL, {_MONEY}, count(*)::BIGINT FROM use""",
    "daily_cost_by_api": f"WITH {USAGE_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, api_type, {_MONEY} AS cost FROM use GROUP BY 1, 2",
    "cost_projections": f"WITH {USAGE_SQL}, b AS (SELECT round(coalesce(sum(cost), 0)::DOUBLE, 8) AS burn FROM use WHERE {_SINCE(_NOW, '1 HOUR')}) SELECT burn AS burn_rate, round(24 * burn, 8) AS daily, round(7 * 24 * burn, 8) AS weekly, round(30 * 24 * burn, 8) AS monthly FROM b",
    "budget_alerts": f"""WITH {USAGE_SQL}, {_budgets("testing")}, s AS (SELECT api_type, {_MONEY} AS cost FROM use WHERE {_DAY} GROUP BY 1),
r AS (SELECT api_type, cost, lim.day_cost, cost / nullif(lim.day_cost::DOUBLE, 0) AS used FROM s JOIN lim USING (api_type))
SELECT api_type, cost, day_cost AS budget, CASE WHEN used IS NULL OR used < 0.7 THEN 'ok' WHEN used < 0.9 THEN 'warning' WHEN used < 1 THEN 'critical' ELSE 'exceeded' END AS alert, round(used, 6) AS used FROM r""",
    "quota_status": f"""WITH {USAGE_SQL}, {_budgets("default")}, d AS (SELECT * FROM use WHERE {_DAY})
SELECT lim.api_type, count(d.id)::BIGINT AS requests_used, lim.rpd AS requests_limit, coalesce(sum(tokens), 0)::BIGINT AS tokens_used, lim.tpd AS tokens_limit, coalesce({_MONEY}, 0) AS cost_used, lim.day_cost AS cost_limit, {_NOW} + INTERVAL 1 DAY AS reset_at
FROM lim LEFT JOIN d ON d.api_type = lim.api_type GROUP BY ALL""",
    "usage_stats": f"WITH {USAGE_SQL} SELECT api_type, count(*)::BIGINT AS requests, sum(tokens)::BIGINT AS tokens, {_MONEY} AS cost, round(avg(tokens), 6) AS avg_tokens FROM use WHERE {_DAY} GROUP BY ALL",
    "usage_hourly_slots": f"""WITH {USAGE_SQL}, a AS (SELECT unnest([{_BY_API}]) AS api_type), s AS (SELECT s::INTEGER AS slot FROM range(24) r(s)),
u AS (SELECT api_type, 23 - (epoch_us({_NOW}) - epoch_us(ts)) // 3600000000 AS slot FROM use WHERE {_DAY})
SELECT a.api_type, s.slot, count(u.slot)::BIGINT AS requests FROM a CROSS JOIN s LEFT JOIN u ON u.api_type = a.api_type AND u.slot = s.slot GROUP BY ALL""",
    "affordability": f"""WITH {USAGE_SQL}, {_budgets("testing")}, r AS (SELECT lim.api_type, lim.day_cost::DECIMAL(12, 4)::DECIMAL(22, 10) - coalesce((SELECT sum(cost) FROM use WHERE use.api_type = lim.api_type AND {_SINCE(_NOW, "1 DAY").replace("- ts", "- use.ts")}), 0) AS rest FROM lim)
SELECT api_type, round(rest::DOUBLE, 8) AS remaining, rest >= 0.01 AS can_afford FROM r""",
    "cleanup_counts": f"WITH t AS (SELECT {_SINCE(_NOW, '7 DAY')} AS live FROM events) SELECT 'gen_metrics' AS log, (SELECT count(*) FROM t WHERE NOT live)::BIGINT AS removed, (SELECT count(*) FROM t WHERE live)::BIGINT AS kept",
    "recovery_suggestions": f"WITH {_ERRORS_SQL} SELECT id, error_type, CASE error_type {_ADVICE} ELSE {_quoted('; '.join(RECOVERY_DEFAULT))} END AS advice FROM err WHERE {_DAY}",
    "topic_catalog": f"SELECT event_id AS id, topic, display, category, hl FROM events JOIN {_CATALOG} ON ord = user_id % 29",
    "option_topics_filter": f"""SELECT event_id AS id, topic, 'long-answer' AS question_type FROM events JOIN {_CATALOG} ON ord = user_id % 29 WHERE event_id % 2 = 1
UNION ALL SELECT event_id, topic, 'multiple-choice' FROM events JOIN {_CATALOG} ON ord = user_id % 29 WHERE event_id % 2 = 0 AND NOT optional""",
    "backoff_delay": """WITH a AS (SELECT e.event_id AS id, count(o.event_id)::INTEGER AS attempt FROM events e JOIN events o ON o.user_id = e.user_id AND o.ts::DATE = e.ts::DATE AND (o.ts, o.event_id) <= (e.ts, e.event_id) AND o.event_type = 'error'
  WHERE e.event_type = 'error' GROUP BY 1)
SELECT id, attempt, CASE WHEN attempt > 4 THEN 30000 ELSE 1000 * (1 << attempt) END::BIGINT AS model_ms, CASE WHEN attempt > 4 THEN 10000 ELSE 500 * (1 << attempt) END::BIGINT AS refine_ms, coalesce([1000, 2000, 5000][attempt], 10000)::INTEGER AS table_ms FROM a""",
    "mask_secret": "SELECT doc_id, CASE WHEN source = '' THEN '' ELSE '****' || CASE WHEN length(source) > 4 THEN source[-4:] ELSE '' END END AS masked FROM documents",
    "truncate_text": "SELECT doc_id, text[1:300] || CASE WHEN text[301:] <> '' THEN '...' ELSE '' END AS preview FROM documents",
}
