"""Queries that parse and judge questions; the expected SQL is written apart, from the rules, for another engine.

``documents`` stand for questions and responses: the whole text is the question, its first four sentences are the
options, topic and answer follow from the id.  Documents without id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import BLANKS, strip
from ..functions.dims import TOPICS, values
from ..operators import parsing, validation
from ..sources.tables import spread, table

_TOPIC_NAMES = [t[0] for t in TOPICS]


def questions(docs: DataFrame) -> DataFrame:
    """``id``, ``topic``, ``question_text``, ``options`` and ``answer``; one in ten has unlabelled options."""
    own = spread(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text"))
    bare = F.transform(F.slice(F.split(F.coalesce("text", F.lit("")), r"\. ", -1), 1, 4), strip)
    opts = F.when(F.pmod("id", F.lit(10)) == 3, bare).otherwise(F.transform(bare, lambda x, i: F.concat(F.char(i + 65), F.lit(") "), x)))
    return own.select(
        "id",
        F.get(F.array(*map(F.lit, _TOPIC_NAMES)), F.pmod("id", F.lit(29)).cast("int")).alias("topic"),
        F.col("text").alias("question_text"),
        opts.alias("options"),
        F.substr(F.lit("ABCDE"), F.pmod("id", F.lit(5)).cast("int") + 1, F.lit(1)).alias("answer"),
    )


def responses(docs: DataFrame) -> DataFrame:
    """``id`` and ``response``: well-formed ones, and others in twelve shapes."""
    q = questions(docs)
    bare = F.transform(F.slice(F.split(F.coalesce("question_text", F.lit("")), r"\. ", -1), 1, 4), lambda x: strip(F.translate(x, "\n\r", "  ")))
    opt = lambda i: F.coalesce(F.get(bare, F.lit(i)), F.lit(""))
    shape = F.pmod("id", F.lit(12))
    head = F.when(shape == 1, "### Output: ").when(shape == 2, "").when(shape == 8, "Question: ").otherwise("QUESTION: ")
    low = F.lower("answer")
    tail = (
        F.when(shape == 5, F.concat(F.lit("Answer: "), low))
        .when(shape == 6, F.concat(F.lit("The answer is "), "answer"))
        .when(shape == 7, "")
        .otherwise(F.concat(F.lit("ANSWER: "), "answer"))
    )
    last = F.when(F.pmod("id", F.lit(7)) == 0, "").otherwise(F.concat(F.lit("D) "), opt(3), F.lit("\n")))
    body = F.concat(head, F.coalesce("question_text", F.lit("")), F.lit("\nA) "), opt(0), F.lit("\n\n\n\nB) "), opt(1), F.lit("\n C. "), opt(2), F.lit(" \n"), last, tail)
    wrapped = F.to_json(F.struct(F.concat(F.lit('{"input":"x","output":""}'), body).alias("response")))
    return q.select("id", F.when(shape == 3, F.replace(body, F.lit("\n"), F.lit("\r\n"))).when(shape == 4, wrapped).otherwise(body).alias("response"))


def _joined(x: str | Column) -> Column:
    return F.array_join(x, "|")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def format_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.format_rules(questions(_docs(spark, sf_dir))).select(
        "id",
        "f.is_valid",
        "f.has_text",
        "f.has_options",
        "f.has_answer",
        F.col("f.option_count").cast("long").alias("option_count"),
        _joined("f.errors.message").alias("errors"),
        _joined("f.errors.severity").alias("severities"),
        _joined("f.warnings.message").alias("warnings"),
        _joined("f.suggestions").alias("suggestions"),
    )


def physics_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.physics_rules(questions(_docs(spark, sf_dir))).select(
        "id",
        "p.is_valid",
        "p.accuracy",
        "p.unit_consistency",
        _joined("p.errors.message").alias("errors"),
        _joined("p.warnings.message").alias("warnings"),
        _joined("p.suggestions").alias("suggestions"),
    )


def compliance_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.compliance_rules(questions(_docs(spark, sf_dir))).select(
        "id",
        "topic",
        F.round("c.relevance", 6).alias("relevance"),
        "c.difficulty",
        _joined("c.warnings.message").alias("warnings"),
        _joined("c.warnings.suggestion").alias("advice"),
        _joined("c.suggestions").alias("suggestions"),
    )


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(questions(_docs(spark, sf_dir))).select(
        "id",
        "v.is_valid",
        "v.acceptable",
        F.round("v.score", 6).alias("score"),
        F.size("v.errors").cast("long").alias("n_errors"),
        F.size("v.warnings").cast("long").alias("n_warnings"),
        F.size("v.suggestions").cast("long").alias("n_suggestions"),
        _joined("v.issues").alias("issues"),
        _joined("v.strengths").alias("strengths"),
    )


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(_docs(spark, sf_dir)).select("id", parsing.parse(F.col("response")).alias("r"))
    return r.select(
        "id",
        "r.success",
        "r.error",
        F.round("r.confidence", 6).alias("confidence"),
        F.md5(F.col("r.question_text").cast("binary")).alias("question_md5"),
        _joined("r.options").alias("options"),
        "r.answer",
    )


def parsing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsing.parse_stats(responses(_docs(spark, sf_dir)))
    return out.select("total", "successes", F.round("avg_confidence", 6).alias("avg_confidence"), _joined("common_errors").alias("common_errors"))


def response_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(_docs(spark, sf_dir)).select("id", parsing.is_valid(F.col("response")).alias("valid"))


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", parsing.error_message(F.col("text")).alias("message"))


# --- expected SQL -----------------------------------------------------------------------------------------------
_W = r"[ \t\n\r\f\x0b]"
_DOT = r"[^\n\r\x{0085}\x{2028}\x{2029}]"
_BLANKS = "' ' || " + " || ".join(f"chr({ord(c)})" for c in BLANKS[1:])
_NUM = "[0-9]+[.]?[0-9]*"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(*items: tuple[str, str]) -> str:
    """A list of the SQL values whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {value} END" for cond, value in items) + "], lambda x: x IS NOT NULL)"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _count(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, {_q(w)})::INT" for w in words) + ")"


_TOPICS_SQL = values([(i, t, d, hl, dims.TOPIC_CONTEXTS[t]) for i, (t, d, _, hl) in enumerate(TOPICS)])
QUESTIONS_SQL = f"""topics(ord, topic, display, hl, context) AS ({_TOPICS_SQL}),
raw AS (SELECT doc_id AS id, coalesce(text, '') AS t, list_transform(string_split(coalesce(text, ''), '. ')[1:4], lambda x: trim(x, {_BLANKS})) AS bare,
    substr('ABCDE', (doc_id % 5)::INT + 1, 1) AS answer FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT id, topic, display, hl, context, t, lower(t) AS low, answer, trim(t, {_BLANKS}) AS bt,
    CASE WHEN id % 10 = 3 THEN bare ELSE list_transform(bare, lambda x, i: chr(64 + i::INT) || ') ' || x) END AS o
  FROM raw JOIN topics ON ord = id % 29)"""


def _number(x: str) -> str:
    head = rf"regexp_replace({x}, '^0+([0-9])', '\1')"
    return f"CASE WHEN contains({x}, '.') THEN regexp_replace({head}, '[.]?0*$', '') ELSE {head} END"


_MISSING = rf"[0-9](?:[0-9.]|{_W}*(?:[^a-zA-Z° \t\n\r\f\x0b0-9.]|$))"
FORMAT_SQL = f"""fmt AS (SELECT id,
  list_concat({_list(("bt = ''", "'high:Question text is missing or empty'"))},
    {_list(("len(o) <> 4", "'high:Expected 4 options, but found ' || len(o)"))},
    list_transform(list_filter(list_zip(o, range(1, len(o) + 1)), lambda z: z[1] IN ('', 'A) ', 'B) ', 'C) ', 'D) ') AND trim(z[1], {_BLANKS}) = ''), lambda z: 'medium:Option ' || z[2] || ' is empty'),
    {_list(("answer = 'E'", "'high:Correct answer must be A, B, C, or D'"), ("answer <> 'E' AND ascii(answer) - 64 > len(o)", "'high:Answer \"' || answer || '\" does not correspond to any option'"))}) AS errors,
  list_concat({_list(("bt <> '' AND length(bt) < 10", "'Question text seems too short'"), ("bt <> '' AND length(t) > 500", "'Question text is very long'"), ("bt <> '' AND NOT contains(t, '?')", "'Question text does not contain a question mark'"))},
    list_transform(list_filter(list_zip(o, range(1, len(o) + 1)), lambda z: NOT starts_with(trim(z[1], {_BLANKS}), chr(64 + z[2]::INT) || ')') AND NOT starts_with(trim(z[1], {_BLANKS}), chr(64 + z[2]::INT) || '.')),
      lambda z: 'Option ' || z[2] || ' should start with "' || chr(64 + z[2]::INT) || ')"'),
    {_list(("len(list_distinct(list_transform(o, lambda x: lower(trim(x, " + _BLANKS + "))))) <> len(o)", "'Some options appear to be duplicates'"))},
    {_list((f"regexp_matches(t, '{_MISSING}')", "'Some numerical values may be missing units'"))},
    list_transform(list_filter(regexp_extract_all(t, '{_NUM}'), lambda x: x::DOUBLE > 1e10 OR x::DOUBLE > 0 AND x::DOUBLE < 1e-6),
      lambda x: CASE WHEN x::DOUBLE > 1 THEN 'Very large number detected: ' ELSE 'Very small number detected: ' END || x)) AS warnings,
  list_transform(list_filter(regexp_extract_all(t, '{_NUM}{_W}*[a-zA-Z°]+'), lambda x: NOT regexp_matches(x, '{_W}')),
    lambda x: 'Consider adding space between number and unit in "' || x || '"') AS suggestions, bt <> '' AS has_text, len(o) AS n, answer <> 'E' AND ascii(answer) - 64 <= len(o) AS has_answer FROM q)"""


def _values(*units: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(t, '(?i)({_NUM}){_W}*{u}', 1)" for u in units) + ", [])"


_UV = rf"({_NUM}){_W}*([a-zA-Z°]+(?:/[a-zA-Z°]+)*(?:\^?-?[0-9]+)?)"
_RANGES = " OR ".join(f"topic = '{t}' AND (x::DOUBLE < {a} OR x::DOUBLE > {b})" for t, (a, b) in dims.USUAL_RANGES.items())
_SPECIAL = "('kinematics', 'forces-momentum', 'work-energy-power', 'current-circuits')"
PHYSICS_SQL = f"""pre AS (SELECT *, list_zip(regexp_extract_all(t, '{_UV}', 1), regexp_extract_all(t, '{_UV}', 2)) AS uv,
    list_concat(regexp_extract_all(t, '{_NUM}'), flatten(list_transform(o, lambda x: regexp_extract_all(x, '{_NUM}')))) AS nums,
    {_values("m/s", "ms⁻¹", "km/h")} AS speeds, {_values("A", "amp", "mA")} AS amps, {_values("V", "volt")} AS volts, {_values("Ω", "ohm", "kΩ")} AS ohms,
    {_values("W", "watt", "kW", "MW")} AS watts, {_values("N", "newton")} AS forces, {_values("kg", "g")} AS masses FROM q),
places AS (SELECT *, list_filter(uv, lambda z: z[2] = 'm/s' AND z[1]::DOUBLE > 299792458) AS fast,
    list_transform(nums, lambda x: CASE WHEN contains({_number("x")}, '.') THEN length({_number("x")}) - instr({_number("x")}, '.') ELSE 0 END) AS prec FROM pre),
phy AS (SELECT id, topic, list_concat(list_transform(fast, lambda z: 'Physically impossible value: ' || {_number("z[1]")} || ' ' || z[2]),
    CASE WHEN topic = 'kinematics' THEN list_transform(list_filter(speeds, lambda x: x::DOUBLE > 300000000), lambda x: 'Velocity ' || {_number("x")} || ' m/s exceeds speed of light') ELSE [] END) AS errors,
  list_concat(list_transform(list_filter(uv, lambda z: regexp_matches(z[2], '[0-9]')), lambda z: 'Unit format may be incorrect: ' || z[2]),
    list_transform(list_filter(nums, lambda x: {_RANGES}), lambda x: 'Number ' || {_number("x")} || ' may have unreasonable order of magnitude for ' || topic),
    {_list(("len(nums) >= 2 AND list_max(prec) - list_min(prec) > 2", "'Inconsistent significant figures in numerical values'"))},
    CASE WHEN topic = 'kinematics' THEN {_list(("NOT contains(low, 'time') AND " + _any("low", ["velocity", "speed", "acceleration"]), "'Kinematic problem may be missing time component'"))}
      WHEN topic = 'current-circuits' THEN list_transform(list_filter(amps, lambda x: x::DOUBLE > 1000), lambda x: 'Very high current value: ' || {_number("x")} || ' A')
      WHEN topic IN {_SPECIAL} THEN []
      ELSE {_list((_any("low", ["graph", "diagram"]), "'Question references visual elements that may not be present'"))} END) AS warnings,
  list_concat(CASE topic WHEN 'kinematics' THEN []
      WHEN 'forces-momentum' THEN {_list(("contains(low, 'force') AND contains(low, 'mass') AND len(forces) > 0 AND len(masses) > 0", "'Verify F = ma relationship in the problem'"), (_any("low", ["collision", "momentum"]), "'Ensure momentum conservation principles are correctly applied'"))}
      WHEN 'work-energy-power' THEN {_list(("contains(low, 'potential') AND contains(low, 'kinetic')", "'Verify energy conservation principles in the solution'"), ("len(watts) > 0 AND contains(low, 'time')", "'Check P = W/t relationship if applicable'"))}
      WHEN 'current-circuits' THEN {_list(("(len(volts) > 0)::INT + (len(amps) > 0)::INT + (len(ohms) > 0)::INT >= 2", "'Verify V = IR relationship in the circuit'"))}
      ELSE {_list((_any("low", ["calculate", "find"]), "'Ensure the question provides sufficient information for calculation'"))} END,
    {_list((_any("t", ["=", "equation"]), "'Verify that any formulas used are correct for the given topic'"), *[(f"topic = '{t}'", _q("Consider if these formulas are relevant: " + ", ".join(f))) for t, f in dims.FORMULAS.items()])}) AS suggestions,
  len(fast) = 0 AS consistent FROM places),
phys AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'major-errors' WHEN len(warnings) > 5 THEN 'minor-issues' ELSE 'accurate' END AS accuracy FROM phy)"""


def _keywords(x: str) -> str:
    stop = ", ".join(_q(w) for w in dims.COMMON_WORDS)
    return rf"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+'), lambda k: length(k) > 2 AND k NOT IN ({stop}))[1:20]"


_CONNECTS = "array_to_string(" + _list(*[(_any("low", w), _q(n)) for n, w in dims.CONNECTIONS.items()]) + ", ', ')"
COMPLIANCE_SQL = f"""kw AS (SELECT *, {_keywords("context")} AS ck, {_keywords("t")} AS qk, {_count("low", dims.HL_WORDS)} AS n_hl, {_count("low", dims.SL_WORDS)} AS n_sl, {_CONNECTS} AS connects FROM q),
rel AS (SELECT *, CASE WHEN len(ck) = 0 OR len(qk) = 0 THEN 0 ELSE len(list_intersect(list_distinct(ck), list_distinct(qk))) / len(list_distinct(list_concat(ck, qk)))::DOUBLE END AS r FROM kw),
com AS (SELECT id, topic, r, CASE WHEN hl OR n_hl > n_sl THEN 'higher' ELSE 'standard' END AS difficulty,
  {_list(("r < 0.5", "'Question may not be sufficiently relevant to ' || display"), ("hl AND n_sl > n_hl", "'HL-only topic should have higher-level question complexity'"), (_any("low", dims.CASUAL_TERMS), "'Question uses casual language not typical of IB Physics'"), ("length(t) < 50", "'Question may lack sufficient context'"), ("contains(low, 'calculate') AND NOT regexp_matches(t, '[0-9]')", "'Calculation question should include numerical values'"))} AS warnings,
  {_list(("r < 0.5", "'Include more concepts related to: ' || array_to_string(ck[1:3], ', ')"), ("hl AND n_sl > n_hl", "'Consider adding more analytical or evaluative elements'"), (_any("low", dims.CASUAL_TERMS), "'Use more formal IB command terms'"), ("length(t) < 50", "'IB questions typically provide more background information'"), ("contains(low, 'calculate') AND NOT regexp_matches(t, '[0-9]')", "'Provide specific values for calculation'"))} AS advice,
  {_list(
    ("r < 0.3", "'Consider focusing more on ' || topic || ' concepts'"),
    ("NOT " + _any("low", dims.COMMAND_TERMS), _q('Consider using IB command terms like "determine", "calculate", or "explain"')),
    (r"length(t) > 200 AND NOT regexp_matches(t, '\([a-z]\)|\(1\)')", _q("Consider breaking complex questions into multiple parts (a), (b), etc.")),
    (rf"regexp_matches(t, '[0-9][0-9][0-9][0-9][0-9][0-9]') AND NOT regexp_matches(t, '{_NUM}{_W}*×{_W}*10\^?-?[0-9]')", _q("Consider using scientific notation for large numbers")),
    ("length(t) > 100 AND NOT " + _any("low", dims.CONCEPT_WORDS), _q("Consider adding conceptual elements to enhance question depth")),
    (_any("low", dims.CONSTANTS) + " AND NOT contains(t, 'data booklet')", _q("Consider referencing the IB Physics data booklet for constants")),
    (_any("t", dims.CONSTANT_VALUES), _q("Values like these are typically provided in the IB data booklet")),
    ("connects <> ''", "'Question connects to: ' || connects || ' - good for IB integration'"),
    (_any("low", dims.REAL_WORLD), _q("Good use of real-world context - aligns with IB philosophy")),
    ("length(t) > 100 AND NOT " + _any("low", dims.REAL_WORLD), _q("Consider adding real-world context to enhance IB alignment")),
  )} AS suggestions FROM rel)"""
_J = "array_to_string({}, '|')".format
SCORE_SQL = """tot AS (SELECT f.id, f.errors AS fe, p.errors AS pe, len(f.errors) + len(p.errors) AS n_errors, len(f.warnings) + len(p.warnings) + len(c.warnings) AS n_warnings,
    len(f.suggestions) + len(p.suggestions) + len(c.suggestions) AS n_suggestions, list_filter(f.errors, lambda x: starts_with(x, 'high:')) AS fh, r, accuracy, consistent
  FROM fmt f JOIN phys p ON f.id = p.id JOIN com c ON f.id = c.id)"""

RESPONSES_SQL = f"""o4 AS (SELECT doc_id AS id, coalesce(text, '') AS t, substr('ABCDE', (doc_id % 5)::INT + 1, 1) AS ans,
    list_transform(string_split(coalesce(text, ''), '. ')[1:4], lambda x: trim(translate(x, chr(10) || chr(13), '  '), {_BLANKS})) AS o FROM documents WHERE doc_id IS NOT NULL),
bodies AS (SELECT id, CASE id % 12 WHEN 1 THEN '### Output: ' WHEN 2 THEN '' WHEN 8 THEN 'Question: ' ELSE 'QUESTION: ' END || t || chr(10) || 'A) ' || coalesce(o[1], '') || repeat(chr(10), 4) || 'B) ' || coalesce(o[2], '')
    || chr(10) || ' C. ' || coalesce(o[3], '') || ' ' || chr(10) || CASE WHEN id % 7 = 0 THEN '' ELSE 'D) ' || coalesce(o[4], '') || chr(10) END
    || CASE id % 12 WHEN 5 THEN 'Answer: ' || lower(ans) WHEN 6 THEN 'The answer is ' || ans WHEN 7 THEN '' ELSE 'ANSWER: ' || ans END AS b FROM o4),
sent AS (SELECT id, CASE id % 12 WHEN 3 THEN replace(b, chr(10), chr(13) || chr(10)) WHEN 4 THEN '{{"response":"' ELSE '' END || CASE WHEN id % 12 = 3 THEN '' ELSE b END AS body, b FROM bodies)"""
_CLEAN = rf"""cleaned AS (SELECT id, regexp_replace(regexp_replace(replace(trim(b, {_BLANKS}), chr(13) || chr(10), chr(10)), '\n\n\n+', chr(10) || chr(10), 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g') AS c FROM bodies)"""
_STOP = rf"(?:\n{_W}*[A-D][).:]{_W}"
_MARKED = rf"""regexp_replace(regexp_replace(c, '\n({_W}*[A-D][).:])', chr(1) || chr(10) || '\1', 'g'), '\n((?:ANSWER|CORRECT_ANSWER|IMPROVEMENTS_MADE):)', chr(1) || chr(10) || '\1', 'g') || chr(1)"""
PARSED_SQL = f"""{_CLEAN},
got AS (SELECT id, c, [trim(regexp_extract(c, '(?i)QUESTION:{_W}*([\\s\\S]+?){_STOP}|\\z)', 1), {_BLANKS}),
      trim(regexp_extract(c, '(?i)###{_W}*Output:{_W}*([\\s\\S]+?){_STOP}|\\z)', 1), {_BLANKS}), trim(regexp_extract(c, '(?i)\\A([\\s\\S]+?){_STOP})', 1), {_BLANKS})] AS texts,
    list_filter(list_transform(regexp_extract_all({_MARKED}, '[A-D][).:](?:{_W}|\\x01)*([^\\n\\r\\x01]+?)\\x01', 1), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS o1,
    list_transform(list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: regexp_matches(x, '^[A-D][).:]{_W}*{_DOT}')), lambda x: trim(regexp_replace(x, '^[A-D][).:]{_W}*', ''), {_BLANKS})) AS o2,
    upper(coalesce(nullif(regexp_extract(c, '(?i)ANSWER:{_W}*([A-D])', 1), ''), nullif(regexp_extract(c, '(?i)Correct answer:{_W}*([A-D])', 1), ''), nullif(regexp_extract(c, '(?i)The answer is{_W}*([A-D])', 1), ''), 'A')) AS a FROM cleaned),
picked AS (SELECT id, c, a, list_filter(texts, lambda x: length(x) > 10)[1] AS t, CASE WHEN len(o1) = 4 THEN o1 WHEN len(o2) = 4 THEN o2 END AS o FROM got),
parsed AS (SELECT *, CASE WHEN t IS NULL THEN 'No question text found' WHEN o IS NULL THEN 'Expected 4 options, found 0' END AS error,
  greatest(1, least(10, 5 + CASE WHEN contains(c, 'QUESTION:') AND contains(c, 'ANSWER:') THEN 2 ELSE 0 END + contains(t, '?')::INT + regexp_matches(t, '[0-9]')::INT
    + (regexp_matches(t, '{_NUM}{_W}*[a-zA-Z°]') OR len(list_filter(o, lambda x: regexp_matches(x, '{_NUM}{_W}*[a-zA-Z°]'))) > 0)::INT
    - CASE WHEN list_sum(list_transform(o, lambda x: length(x))) / 4.0 < 5 THEN 2 ELSE 0 END - CASE WHEN len(list_distinct(list_transform(o, lambda x: lower(trim(x, {_BLANKS}))))) < 4 THEN 3 ELSE 0 END)) / 10.0 AS conf FROM picked)"""

QUERIES = {
    f.__name__: f
    for f in (format_validation, physics_validation, compliance_validation, quality_score, parse_responses, parsing_stats, response_validity, error_messages)
}
_ERR = " ".join
ORACLES = {
    "format_validation": f"WITH {QUESTIONS_SQL},\n{FORMAT_SQL}\nSELECT id, len(errors) = 0 AS is_valid, has_text, n > 0 AS has_options, has_answer, n::BIGINT AS option_count, "
    f"{_J('list_transform(errors, lambda x: substr(x, instr(x, chr(58)) + 1))')} AS errors, {_J('list_transform(errors, lambda x: split_part(x, chr(58), 1))')} AS severities, {_J('warnings')} AS warnings, {_J('suggestions')} AS suggestions FROM fmt",
    "physics_validation": f"WITH {QUESTIONS_SQL},\n{PHYSICS_SQL}\nSELECT id, len(errors) = 0 AS is_valid, accuracy, consistent AS unit_consistency, {_J('errors')} AS errors, {_J('warnings')} AS warnings, {_J('suggestions')} AS suggestions FROM phys",
    "compliance_validation": f"WITH {QUESTIONS_SQL},\n{COMPLIANCE_SQL}\nSELECT id, topic, round(r, 6) AS relevance, difficulty, {_J('warnings')} AS warnings, {_J('advice')} AS advice, {_J('suggestions')} AS suggestions FROM com",
    "quality_score": f"""WITH {QUESTIONS_SQL},\n{FORMAT_SQL},\n{PHYSICS_SQL},\n{COMPLIANCE_SQL},\n{SCORE_SQL}
SELECT id, n_errors = 0 AS is_valid, len(fh) + len(pe) = 0 AS acceptable, round(greatest(0.0, least(100.0, 100 - 20 * (len(fh) + len(pe)) - 10 * (len(fe) - len(fh)) - 2 * n_warnings
    + CASE accuracy WHEN 'major-errors' THEN -30 WHEN 'minor-issues' THEN -10 ELSE 5 END + (r - 0.5) * 20)), 6) AS score, n_errors::BIGINT AS n_errors, n_warnings::BIGINT AS n_warnings, n_suggestions::BIGINT AS n_suggestions,
  array_to_string(list_concat(list_transform(fh, lambda x: substr(x, 6)), pe, {_list(("accuracy = 'major-errors'", "'Physics accuracy issues detected'"), ("r < 0.5", "'Low topic relevance'"))}), '|') AS issues,
  array_to_string({_list(("accuracy = 'accurate'", "'Physically accurate'"), ("r > 0.8", "'Highly relevant to topic'"), ("true", "'IB compliant style'"), ("consistent", "'Consistent units'"))}, '|') AS strengths FROM tot""",
    "parse_responses": f"WITH {RESPONSES_SQL},\n{PARSED_SQL}\nSELECT id, error IS NULL AS success, error, CASE WHEN error IS NULL THEN round(conf, 6) END AS confidence, CASE WHEN error IS NULL THEN md5(t) END AS question_md5, "
    rf"CASE WHEN error IS NULL THEN array_to_string(list_transform(o, lambda x, i: chr(64 + i::INT) || ') ' || regexp_replace(x, '^[A-D]\){_W}*', '')), '|') END AS options, CASE WHEN error IS NULL THEN a END AS answer FROM parsed",
    "parsing_stats": f"WITH {RESPONSES_SQL},\n{PARSED_SQL}\nSELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE error IS NULL)::BIGINT AS successes, coalesce(round(avg(conf) FILTER (WHERE error IS NULL), 6), 0) AS avg_confidence, "
    "(SELECT coalesce(array_to_string(list(e ORDER BY n DESC, e), '|'), '') FROM (SELECT split_part(error, ':', 1) AS e, count(*) AS n FROM parsed WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, e LIMIT 5)) AS common_errors FROM parsed",
    "response_validity": f"WITH {RESPONSES_SQL}\nSELECT id, regexp_matches(body, '(?i)QUESTION:') AND regexp_matches(body, '[A-D][).:]') AND regexp_matches(body, '(?i)ANSWER:') AND length(body) > 30 AS valid FROM sent",
    "error_messages": "SELECT doc_id, coalesce("
    + ", ".join(
        f"CASE WHEN regexp_matches(text, '(?i){p}({_DOT}+)') THEN trim(regexp_extract(text, '(?i){p}({_DOT}+)', 1), {_BLANKS}) END"
        for p in (f"error:{_W}*", f"cannot{_W}+", f"unable{_W}+to{_W}+", f"failed{_W}+to{_W}+")
    )
    + ") AS message FROM documents",
}
