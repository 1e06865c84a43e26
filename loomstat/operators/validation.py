"""Rules over questions: format, physics, compliance, and their summary.

A question has ``id``, ``topic``, ``question_text``, ``options`` (array) and ``answer``.  A null text counts as empty,
null options as missing; repeated rows are judged alike; an empty table gives an empty result.  Errors are structs of
type, message, severity and field, warnings of type, message and suggestion, suggestions are strings.  Lengths count
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, has_any, hits, let, number_text, strings, strip, told
from ..functions.dims import (
    CASUAL_TERMS,
    COMMAND_TERMS,
    COMMON_WORDS,
    CONCEPT_WORDS,
    CONNECTIONS,
    CONSTANT_VALUES,
    CONSTANTS,
    FORMULAS,
    HL_WORDS,
    REAL_WORLD,
    SL_WORDS,
    TOPIC_CONTEXTS,
    TOPICS,
    UNIT_LIMITS,
    USUAL_RANGES,
)

# The messages, suggestions and severities in this module are what consumers of the rules match on.
NUMBER = "[0-9]+[.]?[0-9]*"
_S = r"[ \t\n\r\f\x0b]"
_UNIT = "[a-zA-Z°]"
UNIT_VALUE = rf"({NUMBER}){_S}*({_UNIT}+(?:/{_UNIT}+)*(?:\^?-?[0-9]+)?)"


def _error(kind: str, message: Column, severity: str, field: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), message.alias("message"), F.lit(severity).alias("severity"), (F.lit("") if field is None else field).alias("field")
    )


def _warning(kind: str, message: Column, suggestion: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), message.alias("message"), suggestion.alias("suggestion"))


def _each(values: Column, cond, value) -> Column:
    return F.transform(F.filter(values, cond), value)


# --- format -----------------------------------------------------------------------------------------------------


def format_column() -> Column:
    """Struct of errors, warnings, suggestions, has_text, has_options, has_answer, option_count, is_valid."""
    text, own, answer = F.coalesce("question_text", F.lit("")), F.col("options"), strip(F.coalesce("answer", F.lit("")))
    w = lambda m, s: _warning("format", m if isinstance(m, Column) else F.lit(m), s if isinstance(s, Column) else F.lit(s))
    e = lambda m, sev, field: _error("format", m if isinstance(m, Column) else F.lit(m), sev, field if isinstance(field, Column) else F.lit(field))
    none = own.isNull()
    n = F.when(none, 0).otherwise(F.size(own))
    bare = strip(text)
    empty = bare == ""
    letter = F.upper(answer)
    place = F.ascii(letter) - 65
    opts = F.coalesce(own, strings([]))
    numbered = F.transform(opts, lambda x, i: F.struct(strip(x).alias("x"), (i + 1).alias("i"), F.char(i + 65).alias("l")))
    labelled = lambda s: s["x"].startswith(F.concat(s["l"], F.lit(")"))) | s["x"].startswith(F.concat(s["l"], F.lit(".")))
    text_errors = told((empty, e("Question text is missing or empty", "high", "questionText")))
    option_errors = F.concat(
        told(
            (none, e("Options array is missing or invalid", "high", "options")),
            (~none & (n != 4), e(F.format_string("Expected 4 options, but found %d", n), "high", "options")),
        ),
        _each(
            numbered,
            lambda s: s["x"] == "",
            lambda s: e(F.format_string("Option %d is empty", s["i"]), "medium", F.format_string("options[%d]", s["i"] - 1)),
        ),
    )
    letters = letter.isin("A", "B", "C", "D")
    answer_errors = told(
        (answer == "", e("Correct answer is missing", "high", "suggestedAnswer")),
        ((answer != "") & ~letters, e("Correct answer must be A, B, C, or D", "high", "suggestedAnswer")),
        (letters & (none | (place >= n)), e(F.format_string('Answer "%s" does not correspond to any option', letter), "high", "suggestedAnswer")),
    )
    text_warnings = told(
        (~empty & (F.length(bare) < 10), w("Question text seems too short", "Consider adding more context or detail to the question")),
        (~empty & (F.length(text) > 500), w("Question text is very long", "Consider making the question more concise")),
        (~empty & ~text.contains("?"), w("Question text does not contain a question mark", "Add a question mark to clearly indicate the question")),
    )
    option_warnings = F.concat(
        _each(
            numbered,
            lambda s: ~labelled(s),
            lambda s: w(
                F.format_string('Option %d should start with "%s)"', s["i"], s["l"]), F.format_string('Format option as "%s) %s"', s["l"], s["x"])
            ),
        ),
        told(
            (
                F.size(F.array_distinct(F.transform(opts, lambda x: F.lower(strip(x))))) != F.size(opts),
                w("Some options appear to be duplicates", "Ensure all options are distinct"),
            )
        ),
    )
    # A number is without unit where the greedy match, or any shorter one, is not followed by a letter.
    bare_number = text.rlike(rf"[0-9](?:[0-9.]|{_S}*(?:[^a-zA-Z° \t\n\r\f\x0b0-9.]|\z))")
    size_warnings = lambda ns: F.flatten(
        F.transform(
            ns,
            lambda x: told(
                (x.cast("double") > 1e10, w(F.concat(F.lit("Very large number detected: "), x), "Consider using scientific notation for very large numbers")),
                (
                    (x.cast("double") > 0) & (x.cast("double") < 1e-6),
                    w(F.concat(F.lit("Very small number detected: "), x), "Consider using scientific notation for very small numbers"),
                ),
            ),
        )
    )
    unit_warnings = told((bare_number, w("Some numerical values may be missing units", "Ensure all physical quantities include appropriate units")))
    glued = _each(
        all_of(text, rf"{NUMBER}{_S}*{_UNIT}+"),
        lambda x: ~x.rlike(_S),
        lambda x: F.concat(F.lit('Consider adding space between number and unit in "'), x, F.lit('"')),
    )
    body = lambda errors: F.struct(
        errors.alias("errors"),
        F.concat(text_warnings, option_warnings, unit_warnings, size_warnings(all_of(text, NUMBER))).alias("warnings"),
        glued.alias("suggestions"),
        (~empty).alias("has_text"),
        (n > 0).alias("has_options"),
        (letters & ~none & (place < n)).alias("has_answer"),
        n.alias("option_count"),
        (F.size(errors) == 0).alias("is_valid"),
    )
    return let(F.concat(text_errors, option_errors, answer_errors), body)


# --- physics ----------------------------------------------------------------------------------------------------


def values_of(text: Column, units: list[str]) -> Column:
    """Numbers before any of the units, unit by unit, whatever their case."""
    return F.concat(*[all_of(text, rf"(?i)({NUMBER}){_S}*{u}", 1) for u in units])


def _precision(number: Column) -> Column:
    """Decimals that a number prints with."""
    t = number_text(number)
    return F.when(t.contains("."), F.length(F.substring_index(t, ".", -1))).otherwise(0)


def physics_column() -> Column:
    """Struct of errors, warnings, suggestions, accuracy, unit_consistency, is_valid."""
    return _bound(_physics)


def _bound(rules) -> Column:
    """``rules`` of the text and the text in lower case, both bound once."""
    text = F.coalesce("question_text", F.lit(""))
    return let(F.struct(text.alias("t"), F.lower(text).alias("l")), lambda x: rules(x["t"], x["l"]))


def _physics(text: Column, low: Column) -> Column:
    topic = F.col("topic")
    w = lambda m, s: _warning("physics", m if isinstance(m, Column) else F.lit(m), F.lit(s))
    no_errors = F.array().cast("array<struct<type:string,message:string,severity:string,field:string>>")
    no_warnings = F.array().cast("array<struct<type:string,message:string,suggestion:string>>")
    pairs = F.zip_with(all_of(text, UNIT_VALUE, 1), all_of(text, UNIT_VALUE, 2), lambda v, u: F.struct(v.alias("v"), u.alias("u")))

    def impossible(x: Column) -> Column:
        v, out = x["v"].cast("double"), F.lit(False)
        for unit, (least, most) in UNIT_LIMITS.items():
            beyond = (v < least) if most is None else (v > most)
            out = out | ((x["u"] == unit) & beyond)
        return out

    unit_errors = _each(
        pairs, impossible, lambda x: _error("physics", F.concat(F.lit("Physically impossible value: "), number_text(x["v"]), F.lit(" "), x["u"]), "high")
    )
    unit_warnings = _each(
        pairs, lambda x: x["u"].rlike("[0-9]"), lambda x: w(F.concat(F.lit("Unit format may be incorrect: "), x["u"]), "Check unit notation and formatting")
    )
    opts = F.coalesce("options", strings([]))
    numbers = F.concat(all_of(text, NUMBER), F.flatten(F.transform(opts, lambda o: all_of(o, NUMBER))))

    def usual(x: Column) -> Column:
        out, v = F.lit(False), x.cast("double")
        for t, (least, most) in USUAL_RANGES.items():
            out = out | ((topic == t) & ((v < least) | (v > most)))
        return out

    def size_warnings(ns: Column) -> Column:
        spread = let(F.transform(ns, _precision), lambda p: F.array_max(p) - F.array_min(p))
        return F.concat(
            _each(
                ns,
                usual,
                lambda x: w(
                    F.concat(F.lit("Number "), number_text(x), F.lit(" may have unreasonable order of magnitude for "), topic), "Verify the calculation and units"
                ),
            ),
            told(
                (
                    (F.size(ns) >= 2) & (spread > 2),
                    w("Inconsistent significant figures in numerical values", "Ensure consistent precision throughout the question"),
                )
            ),
        )

    fast = F.filter(values_of(text, ["m/s", "ms⁻¹", "km/h"]), lambda v: v.cast("double") > 300000000)
    topic_errors = F.when(
        topic == "kinematics",
        F.transform(fast, lambda v: _error("physics", F.concat(F.lit("Velocity "), number_text(v), F.lit(" m/s exceeds speed of light")), "high")),
    ).otherwise(no_errors)
    currents = values_of(text, ["A", "amp", "mA"])
    some = lambda units: F.size(values_of(text, units)) > 0
    volts, ohms = some(["V", "volt"]), some(["Ω", "ohm", "kΩ"])
    special = topic.isin("kinematics", "forces-momentum", "work-energy-power", "current-circuits")
    topic_warnings = (
        F.when(
            topic == "kinematics",
            told(
                (
                    ~low.contains("time") & has_any(low, ["velocity", "speed", "acceleration"]),
                    w("Kinematic problem may be missing time component", "Consider if time should be specified or calculated"),
                )
            ),
        )
        .when(
            topic == "current-circuits",
            _each(
                currents,
                lambda v: v.cast("double") > 1000,
                lambda v: w(
                    F.concat(F.lit("Very high current value: "), number_text(v), F.lit(" A")), "Check if current value is realistic for the scenario"
                ),
            ),
        )
        .when(special, no_warnings)
        .otherwise(
            told(
                (
                    has_any(low, ["graph", "diagram"]),
                    w("Question references visual elements that may not be present", "Verify that all referenced diagrams or graphs are included"),
                )
            )
        )
    )
    amps = F.size(currents) > 0
    topic_suggestions = (
        F.when(topic == "kinematics", strings([]))
        .when(
            topic == "forces-momentum",
            told(
                (
                    low.contains("force") & low.contains("mass") & some(["N", "newton"]) & some(["kg", "g"]),
                    F.lit("Verify F = ma relationship in the problem"),
                ),
                (has_any(low, ["collision", "momentum"]), F.lit("Ensure momentum conservation principles are correctly applied")),
            ),
        )
        .when(
            topic == "work-energy-power",
            told(
                (low.contains("potential") & low.contains("kinetic"), F.lit("Verify energy conservation principles in the solution")),
                (some(["W", "watt", "kW", "MW"]) & low.contains("time"), F.lit("Check P = W/t relationship if applicable")),
            ),
        )
        .when(
            topic == "current-circuits",
            told(((volts & amps) | (volts & ohms) | (amps & ohms), F.lit("Verify V = IR relationship in the circuit"))),
        )
        .otherwise(told((has_any(low, ["calculate", "find"]), F.lit("Ensure the question provides sufficient information for calculation"))))
    )
    formulas = F.lit(None).cast("string")
    for t, own in FORMULAS.items():
        formulas = F.when(topic == t, F.lit("Consider if these formulas are relevant: " + ", ".join(own))).otherwise(formulas)
    formula_suggestions = told(
        (has_any(text, ["=", "equation"]), F.lit("Verify that any formulas used are correct for the given topic")), (formulas.isNotNull(), formulas)
    )

    def body(x: Column) -> Column:
        high = F.size(x["errors"])
        return F.struct(
            x["errors"].alias("errors"),
            x["warnings"].alias("warnings"),
            F.concat(topic_suggestions, formula_suggestions).alias("suggestions"),
            F.when(high > 0, "major-errors").when(F.size(x["warnings"]) > 5, "minor-issues").otherwise("accurate").alias("accuracy"),
            (x["n_units"] == 0).alias("unit_consistency"),
            (high == 0).alias("is_valid"),
        )

    found = let(
        unit_errors,
        lambda ue: F.struct(
            F.concat(ue, topic_errors).alias("errors"),
            F.concat(unit_warnings, let(numbers, size_warnings), topic_warnings).alias("warnings"),
            F.size(ue).alias("n_units"),
        ),
    )
    return let(found, body)


# --- compliance -------------------------------------------------------------------------------------------------


def keywords(text: Column) -> Column:
    """The first twenty words that say something."""
    return F.slice(F.filter(all_of(F.lower(text), "[a-z0-9_]{3,}"), lambda x: ~x.isin(COMMON_WORDS)), 1, 20)


def jaccard(a: Column, b: Column) -> Column:
    """Zero when either side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def with_topics(df: DataFrame) -> DataFrame:
    """``df`` with ``display``, ``higher_only`` and ``context`` of its topic."""
    rows = [(t, d, hl, TOPIC_CONTEXTS[t]) for t, d, _, hl in TOPICS]
    dim = df.sparkSession.createDataFrame(rows, "topic string, display string, higher_only boolean, context string")
    return df.join(F.broadcast(dim), "topic")


def relevance(low: Column) -> Column:
    """Similarity of a text (lower case) to what its topic is about."""
    return let(keywords(low), lambda own: jaccard(keywords(F.col("context")), own))


def difficulty(hl: Column, sl: Column) -> Column:
    """From the words of either level that a text has; topics of the higher level stay there."""
    return F.when(F.col("higher_only") | (hl > sl), "higher").otherwise("standard")


def compliance_column() -> Column:
    """Struct of warnings, suggestions, relevance, difficulty, compliant, is_valid; reads what :func:`with_topics` adds."""
    return _bound(_compliance)


def _compliance(text: Column, low: Column) -> Column:
    topic = F.col("topic")
    w = lambda m, s: _warning("compliance", m if isinstance(m, Column) else F.lit(m), s if isinstance(s, Column) else F.lit(s))
    n = F.length(text)
    about = keywords(F.col("context"))
    style_warnings = told(
        (has_any(low, CASUAL_TERMS), w("Question uses casual language not typical of IB Physics", "Use more formal IB command terms")),
        (n < 50, w("Question may lack sufficient context", "IB questions typically provide more background information")),
        (
            low.contains("calculate") & ~text.rlike("[0-9]"),
            w("Calculation question should include numerical values", "Provide specific values for calculation"),
        ),
    )
    connects = F.concat_ws(", ", *[F.when(has_any(low, words), name) for name, words in CONNECTIONS.items()])
    real = has_any(low, REAL_WORLD)
    style_suggestions = told(
        (~has_any(low, COMMAND_TERMS), F.lit('Consider using IB command terms like "determine", "calculate", or "explain"')),
        ((n > 200) & ~text.rlike(r"\([a-z]\)|\(i\)|\(1\)"), F.lit("Consider breaking complex questions into multiple parts (a), (b), etc.")),
        (
            text.rlike("[0-9]{6,}") & ~text.rlike(rf"{NUMBER}{_S}*×{_S}*10\^?-?[0-9]+"),
            F.lit("Consider using scientific notation for large numbers"),
        ),
        ((n > 100) & ~has_any(low, CONCEPT_WORDS), F.lit("Consider adding conceptual elements to enhance question depth")),
        (has_any(low, CONSTANTS) & ~text.contains("data booklet"), F.lit("Consider referencing the IB Physics data booklet for constants")),
        (has_any(text, CONSTANT_VALUES), F.lit("Values like these are typically provided in the IB data booklet")),
        (connects != "", F.concat(F.lit("Question connects to: "), connects, F.lit(" - good for IB integration"))),
        (real, F.lit("Good use of real-world context - aligns with IB philosophy")),
        (~real & (n > 100), F.lit("Consider adding real-world context to enhance IB alignment")),
    )

    def body(x: Column) -> Column:
        r, hl, sl = x["r"], x["hl"], x["sl"]
        return F.struct(
            F.concat(
                told(
                    (
                        r < 0.5,
                        w(
                            F.concat(F.lit("Question may not be sufficiently relevant to "), F.col("display")),
                            F.concat(F.lit("Include more concepts related to: "), F.array_join(F.slice(about, 1, 3), ", ")),
                        ),
                    ),
                    (
                        F.col("higher_only") & (sl > hl),
                        w("HL-only topic should have higher-level question complexity", "Consider adding more analytical or evaluative elements"),
                    ),
                ),
                style_warnings,
            ).alias("warnings"),
            F.concat(told((r < 0.3, F.concat(F.lit("Consider focusing more on "), topic, F.lit(" concepts")))), style_suggestions).alias("suggestions"),
            r.alias("relevance"),
            difficulty(hl, sl).alias("difficulty"),
            F.lit(True).alias("compliant"),
            F.lit(True).alias("is_valid"),
        )

    return let(F.struct(relevance(low).alias("r"), hits(low, HL_WORDS).alias("hl"), hits(low, SL_WORDS).alias("sl")), body)


# --- all together -----------------------------------------------------------------------------------------------


def format_rules(questions: DataFrame) -> DataFrame:
    return questions.select("id", format_column().alias("f"))


def physics_rules(questions: DataFrame) -> DataFrame:
    return questions.select("id", physics_column().alias("p"))


def compliance_rules(questions: DataFrame) -> DataFrame:
    """Questions of unknown topics are left out, as there is nothing to compare them with."""
    return with_topics(questions).select("id", "topic", compliance_column().alias("c"))


def validate(questions: DataFrame) -> DataFrame:
    """``id``, ``f``, ``p``, ``c`` and ``v``: all errors, warnings and suggestions in this order, score, issues, strengths."""
    parts = with_topics(questions).select("id", format_column().alias("f"), physics_column().alias("p"), compliance_column().alias("c"))
    errors = F.concat("f.errors", "p.errors")  # compliance finds none
    warnings = F.concat("f.warnings", "p.warnings", "c.warnings")

    def body(x: Column) -> Column:
        points = F.aggregate(x["errors"], F.lit(0.0), lambda a, e: a + F.when(e["severity"] == "high", 20.0).when(e["severity"] == "medium", 10.0).otherwise(5.0))
        accuracy = F.col("p.accuracy")
        physics = F.when(accuracy == "major-errors", -30.0).when(accuracy == "minor-issues", -10.0).otherwise(5.0)
        score = 100 - points - 2.0 * F.size(x["warnings"]) + physics + (F.col("c.relevance") - 0.5) * 20
        high = F.filter(x["errors"], lambda e: e["severity"] == "high")
        return F.struct(
            x["errors"].alias("errors"),
            x["warnings"].alias("warnings"),
            F.concat("f.suggestions", "p.suggestions", "c.suggestions").alias("suggestions"),
            (F.col("f.is_valid") & F.col("p.is_valid") & F.col("c.is_valid")).alias("is_valid"),
            ((F.size(high) == 0) & (accuracy != "major-errors")).alias("acceptable"),
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"),
            F.concat(
                F.transform(high, lambda e: e["message"]),
                told(
                    (accuracy == "major-errors", F.lit("Physics accuracy issues detected")), (F.col("c.relevance") < 0.5, F.lit("Low topic relevance"))
                ),
            ).alias("issues"),
            told(
                (accuracy == "accurate", F.lit("Physically accurate")),
                (F.col("c.relevance") > 0.8, F.lit("Highly relevant to topic")),
                (F.col("c.compliant"), F.lit("IB compliant style")),
                (F.col("p.unit_consistency"), F.lit("Consistent units")),
            ).alias("strengths"),
        )

    both = F.struct(errors.alias("errors"), warnings.alias("warnings"))
    return parts.select("id", "f", "p", "c", let(both, body).alias("v"))

