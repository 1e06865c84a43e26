"""Records around a question: requests, final and fallback questions, errors, settings, contrast, providers' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, strings
from ..functions.dims import FALLBACK_OPTIONS, FALLBACKS, LEGACY_TOPICS, MODEL_SETTINGS, TOPICS

#: Settings that a request may change.
ALLOWED = ("litUrl", "litToken", "litProxyUrl", "huggingfaceApiKey", "googleApiKey", "openRouterApiKey", "llamaModelId", "refinementProvider", "useOwnerCredits")
_TOPIC_IDS = [t[0] for t in TOPICS]

# The messages, codes and texts of solutions in this module.


def truthy(x: Column) -> Column:
    """Present and not empty."""
    return F.coalesce(x != "", F.lit(False))


def validate_request(body: Column) -> Column:
    """Struct of valid, error, topic, difficulty and type of a JSON request; the first rule that fails tells the error."""
    get = lambda k: F.get_json_object(body, f"$.{k}")
    is_object = F.coalesce(body.rlike(r"\A\s*\{") & F.try_parse_json(body).isNotNull(), F.lit(False))
    legacy = truthy(get("prompt")) | truthy(get("questionType"))
    difficulty, kind, topic = F.coalesce(get("difficulty"), F.lit("standard")), F.coalesce(get("type"), F.lit("multiple-choice")), get("topic")
    aliases = F.create_map(*[F.lit(x) for kv in LEGACY_TOPICS.items() for x in kv])
    old_topic = F.coalesce(aliases[F.lower(get("topics[0]"))], F.lit("kinematics"))
    old_type = F.when(get("questionType") == "mcq", "multiple-choice").otherwise("long-answer")
    error = (
        F.when(~is_object, "Invalid request body")
        .when(legacy, None)
        .when(~truthy(topic), "Topic is required")
        .when(~topic.isin(_TOPIC_IDS), "Invalid topic. Must be one of: " + ", ".join(_TOPIC_IDS))
        .when(~difficulty.isin("standard", "higher"), 'Difficulty must be "standard" or "higher"')
        .when(~kind.isin("multiple-choice", "long-answer"), 'Type must be "multiple-choice" or "long-answer"')
    )
    return let(
        error,
        lambda e: F.struct(
            e.isNull().alias("valid"),
            e.alias("error"),
            F.when(e.isNull(), F.when(legacy, old_topic).otherwise(topic)).alias("topic"),
            F.when(e.isNull(), F.when(legacy, "standard").otherwise(difficulty)).alias("difficulty"),
            F.when(e.isNull(), F.when(legacy, old_type).otherwise(kind)).alias("type"),
        ),
    )


def explanation(topic: Column, improvements: Column) -> Column:
    more = F.when(F.size(improvements) > 0, F.concat(F.lit(" Improvements made: "), F.array_join(improvements, ", "))).otherwise("")
    return F.concat(F.lit("This question tests understanding of "), topic, F.lit("."), more)


def final_question(raw: Column, refined: Column, topic: Column, kind: Column, error: Column) -> Column:
    """The refined question, or the raw one with the reason why it stands in.  ``raw``: question_text, options, answer; ``refined`` also improvements."""
    ok = refined.isNotNull() & error.isNull()
    return F.struct(
        topic.alias("topic"),
        F.when(ok, refined["question_text"]).otherwise(raw["question_text"]).alias("question_text"),
        F.when(ok, refined["options"]).otherwise(raw["options"]).alias("options"),
        F.when(ok, refined["answer"]).otherwise(raw["answer"]).alias("correct_answer"),
        F.when(ok, explanation(topic, refined["improvements"]))
        .otherwise(F.concat(F.lit("Fallback question ("), F.coalesce(error, F.lit("Refinement disabled")), F.lit("). Original Llama-generated content.")))
        .alias("explanation"),
        ok.alias("refinement_applied"),
        kind.alias("type"),
        F.lit("standard").alias("difficulty"),
    )


def normalise_error(stage: Column, message: Column) -> Column:
    """Struct of type, message and retryable of an error that has no type yet."""
    stage, m = F.coalesce(stage, F.lit("")), F.coalesce(message, F.lit(""))
    refine, check = stage.contains("openrouter") | stage.contains("refinement"), stage.contains("validation")
    limit = ~refine & ~check & ~m.contains("timeout") & (m.contains("quota") | m.contains("limit"))
    kind = F.when(refine, "openrouter_failure").when(check, "validation_failure").when(limit, "api_limit").otherwise("llama_failure")
    text = F.concat(F.lit("Generation failed at "), stage, F.lit(": "), F.when(m == "", "Unknown error").otherwise(m))
    return F.struct(kind.alias("type"), text.alias("message"), (~limit).alias("retryable"))


def status_of(message: Column) -> Column:
    """Struct of status and code; the first word found decides."""
    m = F.coalesce(message, F.lit(""))
    pick = lambda a, b, c, d: F.when(m.contains("quota") | m.contains("limit"), a).when(m.contains("timeout"), b).when(m.contains("validation"), c).otherwise(d)
    return F.struct(pick(429, 408, 422, 500).alias("status"), pick("QUOTA_EXCEEDED", "TIMEOUT", "VALIDATION_FAILED", "GENERATION_FAILED").alias("code"))


def is_auth_error(message: Column) -> Column:
    """Errors that no retry mends."""
    return F.coalesce(message.rlike(r"(?i)API_KEY_INVALID|api key not valid|invalid api key|unauthorized"), F.lit(False))


def sane(question_text: Column, options: Column, answer: Column, confidence: Column) -> Column:
    """Whether a generated question may be returned at all."""
    ok = (F.length(question_text) >= 10) & (F.size(options) == 4) & answer.isin("A", "B", "C", "D") & (confidence >= 0.1)
    return F.coalesce(ok, F.lit(False))


def fallback_bank(df: DataFrame) -> DataFrame:
    """``topic``, ``k``, ``of``, ``question_text``, ``options``, ``correct_answer``: curated ones, and a general one for every other topic."""
    spark = df.sparkSession
    curated = spark.createDataFrame(FALLBACKS, "topic string, k int, question_text string, options array<string>, correct_answer string")
    topics = spark.createDataFrame([(t,) for t in _TOPIC_IDS], "topic string")
    general = topics.join(curated, "topic", "left_anti").select(
        "topic",
        F.lit(0).alias("k"),
        F.concat(F.lit("This is a fallback question for "), "topic", F.lit(". What is the correct answer?")).alias("question_text"),
        strings(FALLBACK_OPTIONS).alias("options"),
        F.lit("A").alias("correct_answer"),
    )
    both = curated.unionByName(general)
    return both.join(both.groupBy("topic").agg(F.count(F.lit(1)).alias("of")), "topic")


def pick_fallback(requests: DataFrame) -> DataFrame:
    """For each request (``id``, ``topic``) one fallback, the same in every run: its id picks among the topic's."""
    bank = F.broadcast(fallback_bank(requests))
    return requests.join(bank, "topic").filter(F.pmod("id", "of") == F.col("k")).select("id", "topic", "question_text", "options", "correct_answer")


def format_response(question: DataFrame) -> DataFrame:
    """``id``, ``kind`` (mcq or long), ``topic``, ``question``, ``options`` (without labels), ``correct`` (place), ``solution`` and ``theory``.

    ``question`` has id, display, question_text, options, correct_answer, explanation and type.
    """
    q, mcq = question, F.col("type") == "multiple-choice"
    has = truthy(F.col("explanation"))
    steps = [
        "This is an AI-generated long-answer question.",
        "Approach this systematically by identifying given values,",
        "selecting appropriate physics equations,",
        "substituting values carefully,",
        "and presenting your solution clearly with proper units.",
    ]
    notes = F.array(
        F.lit("This question was generated using AI and refined for accuracy."),
        F.lit("The answer demonstrates proper application of IB Physics principles."),
        F.concat(F.lit("Topic: "), "display"),
    )
    theory = F.concat(F.lit("Topic: "), "display", F.lit(" - "), F.when(has, F.col("explanation")).otherwise("Generated using advanced AI models trained on IB Physics curriculum."))
    return q.select(
        "id",
        F.when(mcq, "mcq").otherwise("long").alias("kind"),
        F.col("display").alias("topic"),
        F.col("question_text").alias("question"),
        F.when(mcq, F.transform("options", lambda x: F.regexp_replace(x, r"\A[A-D]\)\s*", ""))).alias("options"),
        F.when(mcq, F.ascii("correct_answer") - 65).alias("correct"),
        F.when(mcq, F.when(has, F.array("explanation")).otherwise(notes))
        .otherwise(F.when(has, F.split("explanation", "\n")).otherwise(strings(steps)))
        .alias("solution"),
        F.when(mcq, theory).otherwise(F.concat(F.lit("Topic: "), "display", F.lit(" - Advanced problem requiring detailed analysis and calculation."))).alias("theory"),
    )


def merge_settings(current: Column, changes: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Maps: allowed keys of ``changes`` replace those of ``current``."""
    own = F.map_filter(changes, lambda k, _: k.isin(*allowed))
    return F.map_concat(F.map_filter(current, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def merged(base: dict[str, Column], over: dict[str, Column]) -> dict[str, Column]:
    """Shallow merge of records: what ``over`` has, else what ``base`` has."""
    return {k: F.coalesce(over[k], base[k]) if k in over and k in base else over.get(k, base.get(k)) for k in {**base, **over}}


def record_id(prefix: str, ts: Column, *parts: Column) -> Column:
    """A name that is the same in every run: time in milliseconds and a hash of what the record is."""
    ms = F.unix_millis(ts.cast("timestamp")).cast("string")
    return F.concat(F.lit(prefix + "-"), ms, F.lit("-"), F.substr(F.sha2(F.concat_ws("|", ms, *[p.cast("string") for p in parts]), 256), F.lit(1), F.lit(9)))


def model_settings(df: DataFrame, column: str = "model_id") -> DataFrame:
    """``df`` with the settings of the model that the last part of its id names; nulls for others."""
    dim = df.sparkSession.createDataFrame(MODEL_SETTINGS, "model string, temperature double, max_tokens int, top_p double")
    return df.withColumn("model", F.element_at(F.split(column, "/"), -1)).join(F.broadcast(dim), "model", "left")


def luminance(r: Column, g: Column, b: Column) -> Column:
    lin = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def contrast(one: Column, two: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


_SHOWN = "questionText string, options array<string>, correctAnswer string"
_BODY = f"success boolean, question string, formatted struct<question:string,options:array<string>,correct:double>, {_SHOWN}"


def shown_question(body: Column) -> Column:
    """Struct of question_text, options and correct_answer that a client shows of an answer's body; null where there is no text.

    The question lies under ``question`` if the answer succeeded, if it is nested once more or if nothing tells of success;
    else the body is the question itself.  A ``formatted`` part that comes with it goes before what the question says.
    """

    def show(x: Column) -> Column:
        nested = F.coalesce(F.get_json_object(x["question"], "$.question"), F.lit("")) != ""
        inside = x["question"].isNotNull() & (F.coalesce(x["success"], F.lit(True)) | nested)
        own = F.when(inside, F.from_json(x["question"], _SHOWN)).otherwise(F.struct(x["questionText"].alias("questionText"), x["options"].alias("options"), x["correctAnswer"].alias("correctAnswer")))
        form = F.when(inside, x["formatted"])
        lettered = F.transform(form["options"], lambda o, i: F.concat(F.char(i + 65), F.lit(") "), o))

        def with_form(own: Column) -> Column:
            text = F.coalesce(F.nullif(form["question"], F.lit("")), own["questionText"])
            options = F.when(F.size(form["options"]) > 0, lettered).otherwise(own["options"])
            answer = F.coalesce(F.char(form["correct"].cast("int") + 65), own["correctAnswer"])
            return F.when(F.coalesce(text, F.lit("")) != "", F.struct(text.alias("question_text"), options.alias("options"), answer.alias("correct_answer")))

        return let(own, with_form)

    return let(F.from_json(body, _BODY), show)
