"""Model responses to records: columns of text, whatever its shape; what does not parse is null or an error, never a crash.

A null response has no question text.  Line ends of ``\\r\\n`` count as ``\\n``; each line is trimmed of blanks and tabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, let, strip

_S = r"[ \t\n\r\f\x0b]"
_OPTION = r"[A-D][).:]"
_TO_OPTION = rf"(?=\n{_S}*[A-D][).:]{_S}"
QUESTION_PATTERNS = (
    rf"(?i)QUESTION:{_S}*([\s\S]+?){_TO_OPTION}|\z)",
    rf"(?i)###{_S}*Output:{_S}*([\s\S]+?){_TO_OPTION}|\z)",
    rf"(?i)\A([\s\S]+?){_TO_OPTION})",
)
ANSWER_PATTERNS = (rf"(?i)ANSWER:{_S}*([A-D])", rf"(?i)Correct answer:{_S}*([A-D])", rf"(?i)The answer is{_S}*([A-D])")
ERROR_PATTERNS = (rf"(?i)error:{_S}*(.+)", rf"(?i)cannot{_S}+(.+)", rf"(?i)unable{_S}+to{_S}+(.+)", rf"(?i)failed{_S}+to{_S}+(.+)")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def clean(response: Column) -> Column:
    """Unwraps ``{"response": "..."}`` and what it repeats of its prompt; evens out line ends and blank lines."""
    raw = F.coalesce(response, F.lit(""))
    inner = F.get_json_object(raw, "$.response")
    at = F.instr(inner, '"}')
    tail = F.when(at > 0, strip(F.substr(inner, at + 2))).otherwise(inner)
    body = F.when(raw.startswith('{"response":"') & (F.coalesce(inner, F.lit("")) != ""), tail).otherwise(raw)
    even = F.regexp_replace(F.replace(strip(body), F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n")
    return F.regexp_replace(even, r"(?md)^[ \t]+|[ \t]+$", "")


def question_text(cleaned: Column) -> Column:
    """Null where no pattern gives more than ten characters."""
    long = lambda hit: F.when(F.length(hit) > 10, hit)
    return F.coalesce(*[let(strip(F.regexp_extract(cleaned, p, 1)), long) for p in QUESTION_PATTERNS])


def options(cleaned: Column) -> Column:
    """The four options without labels; null where there are not exactly four."""
    own = rf"[A-D][).:]{_S}*(.+?)(?=\n{_S}*{_OPTION}|\n(?:ANSWER|CORRECT_ANSWER|IMPROVEMENTS_MADE):|\z)"
    first = F.filter(F.transform(all_of(cleaned, own, 1), strip), lambda x: x != "")
    lines = F.filter(F.transform(F.split(cleaned, "\n"), strip), lambda x: x.rlike(rf"\A{_OPTION}{_S}*."))
    other = F.transform(lines, lambda x: strip(F.regexp_replace(x, rf"\A{_OPTION}{_S}*", "")))
    four = lambda xs, rest: let(xs, lambda v: F.when(F.size(v) == 4, v).otherwise(rest))
    return four(first, four(other, F.lit(None).cast("array<string>")))


def answer(cleaned: Column) -> Column:
    """The letter; ``A`` stands where none is told."""
    return F.coalesce(*[F.upper(F.nullif(F.regexp_extract(cleaned, p, 1), F.lit(""))) for p in ANSWER_PATTERNS], F.lit("A"))


def labelled(opts: Column) -> Column:
    return F.transform(opts, lambda x, i: F.concat(F.char(i + 65), F.lit(") "), F.regexp_replace(x, rf"\A[A-D]\){_S}*", "")))


def confidence(cleaned: Column, text: Column, opts: Column) -> Column:
    """Tenths are summed as whole numbers, so that the sum is exact."""
    units = rf"[0-9]+[.]?[0-9]*{_S}*[a-zA-Z°]+"
    short = F.aggregate(opts, F.lit(0), lambda a, x: a + F.length(x)) < 5 * F.size(opts)
    same = F.size(F.array_distinct(F.transform(opts, lambda x: F.lower(strip(x))))) < F.size(opts)
    tenths = (
        F.lit(5)
        + F.when(cleaned.contains("QUESTION:") & cleaned.contains("ANSWER:"), 2).otherwise(0)
        + text.contains("?").cast("int")
        + text.rlike("[0-9]").cast("int")
        + (text.rlike(units) | F.exists(opts, lambda x: x.rlike(units))).cast("int")
        - F.when(short, 2).otherwise(0)
        - F.when(same, 3).otherwise(0)
    )
    return F.greatest(F.lit(1), F.least(F.lit(10), tenths)) / F.lit(10.0)


def parse(response: Column) -> Column:
    """Struct of success, error, confidence, question_text, options (labelled) and answer."""

    def body(c: Column) -> Column:
        parts = F.struct(question_text(c).alias("t"), options(c).alias("o"), answer(c).alias("a"))

        def judged(x: Column) -> Column:
            error = F.when(x["t"].isNull(), "No question text found").when(x["o"].isNull(), "Expected 4 options, found 0")
            ok = error.isNull()
            return F.struct(
                ok.alias("success"),
                error.alias("error"),
                F.when(ok, confidence(c, x["t"], x["o"])).alias("confidence"),
                F.when(ok, x["t"]).alias("question_text"),
                F.when(ok, labelled(x["o"])).alias("options"),
                F.when(ok, x["a"]).alias("answer"),
            )

        return let(parts, judged)

    return let(clean(response), body)


def is_valid(response: Column) -> Column:
    r = F.coalesce(response, F.lit(""))
    return r.rlike("(?i)QUESTION:") & r.rlike(_OPTION) & r.rlike("(?i)ANSWER:") & (F.length(r) > 30)


def error_message(response: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(ERROR_PATTERNS):
        out = F.coalesce(strip(found(response, p)), out)
    return out


def parse_stats(responses: DataFrame, column: str = "response") -> DataFrame:
    """One row: totals, mean confidence of what parsed, and the five most frequent errors (ties by name)."""
    parsed = responses.select(parse(F.col(column)).alias("r")).select(
        F.split_part("r.error", F.lit(":"), F.lit(1)).alias("error"), F.col("r.confidence").alias("confidence")
    )
    by = parsed.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    worst = F.slice(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct((-F.col("n")).alias("k"), "error")))), 1, 5)
    ok = F.sum(F.when(F.col("error").isNull(), F.col("n")).otherwise(0))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(ok, F.lit(0)).cast("long").alias("successes"),
        F.coalesce(F.sum("c") / F.nullif(ok, F.lit(0)), F.lit(0.0)).alias("avg_confidence"),
        F.transform(worst, lambda x: x["error"]).alias("common_errors"),
    )


# --- other shapes -----------------------------------------------------------------------------------------------


def parse_refined(response: Column, text: Column, opts: Column, suggested: Column) -> Column:
    """Struct of question_text, options, answer and up to five improvements; what is absent comes from the original."""
    r = F.coalesce(response, F.lit(""))
    own = found(r, rf"(?i)Refined Question:{_S}*([\s\S]*?)(?=[A-D]\)|CORRECT_ANSWER)")
    pattern = rf"([A-D]\){_S}*.+?)(?=\n[A-D]\)|\nCORRECT_ANSWER|\z)"
    four = let(
        all_of(r, pattern, 1),
        lambda xs: F.when(
            F.size(xs) == 4, F.transform(xs, lambda x: F.concat(F.left(x, F.lit(1)), F.lit(") "), strip(F.regexp_replace(x, rf"\A[A-D]\){_S}*", ""))))
        ).otherwise(opts),
    )
    told_ = F.coalesce(found(r, rf"(?i)IMPROVEMENTS_MADE:{_S}*([\s\S]*)\z"), F.lit(""))
    items = F.slice(F.filter(F.transform(F.split(told_, r"[\n-]"), strip), lambda x: x != ""), 1, 5)
    return F.struct(
        F.coalesce(strip(own), text).alias("question_text"),
        four.alias("options"),
        F.coalesce(found(r, rf"(?i)CORRECT_ANSWER:{_S}*([A-D])"), suggested).alias("answer"),
        items.alias("improvements"),
    )


def parse_lines(response: Column) -> Column:
    """Struct of question, options, answer and confidence, line by line: question until the first option; null if a part lacks.

    The letter is looked for after the colon, so that the word ANSWER does not answer itself.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), strip), lambda x: x != "")
    is_option = lambda x: x.rlike(r"\A[ABCD]\)")
    is_answer = lambda x: x.rlike(r"(?i)\A(?:ANSWER|CORRECT):")

    def body(ls: Column) -> Column:
        opts = F.filter(ls, is_option)
        first = F.coalesce(F.array_position(F.transform(ls, is_option), True), F.lit(0))
        head = F.when(first > 0, F.slice(ls, F.lit(1), F.greatest(first - 1, F.lit(0)))).otherwise(ls)
        text = F.array_join(F.filter(head, lambda x: ~is_answer(x)), " ")
        letters = F.filter(
            F.transform(F.filter(ls, is_answer), lambda x: F.regexp_extract(F.upper(x), r":[^ABCD]*([ABCD])", 1)), lambda x: x != ""
        )
        letter = F.get(letters, F.size(letters) - 1)
        good = (text != "") & (F.size(opts) == 4) & letter.isNotNull()
        return F.when(
            good,
            F.struct(
                text.alias("question"),
                F.transform(opts, lambda x: strip(F.substr(x, F.lit(3)))).alias("options"),
                letter.alias("answer"),
                F.lit(0.8).alias("confidence"),
            ),
        )

    return let(lines, body)


def parse_json_object(response: Column) -> Column:
    """Struct of question, options and correct_answer from the first ``{`` to the last ``}``; null unless whole."""
    r = F.coalesce(response, F.lit(""))
    part = F.regexp_extract(r, r"\{[\s\S]*\}", 0)
    row = F.from_json(part, "question string, options array<string>, correct_answer string")
    return let(
        row,
        lambda x: F.when(x["question"].isNotNull() & (F.size(x["options"]) == 4) & x["correct_answer"].isin("A", "B", "C", "D"), x),
    )


def parse_options_section(response: Column) -> Column:
    """Struct of question_text, options and answer from a text with OPTIONS: and CORRECT_ANSWER:; null unless four options and a letter."""
    r = F.coalesce(response, F.lit(""))
    text = F.coalesce(strip(found(r, rf"(?i)REFINED_QUESTION:{_S}*(.+?)(?=\n\n|\nOPTIONS:|\z)")), F.lit(""))
    start, stop = F.instr(r, "OPTIONS:"), F.instr(r, "CORRECT_ANSWER:")
    # As the end is the first mark of the whole text, one before the options leaves nothing between them.
    section = F.when(stop == 0, F.substr(r, start + 8)).when(stop > start + 8, F.substr(r, start + 8, stop - start - 8)).otherwise("")
    opts = let(section, lambda x: F.transform(all_of(x, rf"([A-D]\){_S}*.+?)(?=\n[A-D]\)|\z)", 1), strip))
    even = lambda x: F.concat(F.left(x, F.lit(2)), F.lit(" "), strip(F.substr(x, F.lit(3))))
    letter = F.upper(found(r, rf"(?i)CORRECT_ANSWER:{_S}*([A-D])"))
    return let(
        opts,
        lambda xs: F.when(
            (start > 0) & (F.size(xs) == 4) & letter.isNotNull(),
            F.struct(
                F.when(text == "", "Question text not found").otherwise(text).alias("question_text"),
                F.transform(xs, even).alias("options"),
                letter.alias("answer"),
            ),
        ),
    )


def json_envelope(raw: Column) -> Column:
    """The text of a provider's answer: the first of five places that is not empty, else the raw answer."""
    paths = ("$.results[0].text", "$.generated_text", "$.output[0].text", "$.output[0].generated_text", "$.data[0].text")
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(*[some(F.get_json_object(raw, p)) for p in paths], some(raw))


def json_tail(text: Column) -> Column:
    """What follows the shortest leading JSON value that ends in ``}``; without a tail the value's own output.

    Without such a value: what follows the first brace with a blank after it, else the text.
    """
    # Only where the first brace is closed can such a value end: one pass over escapes, quotes, braces and what is between.
    tokens = all_of(text, r'\\.|["{}]|[^\\"{}]+|\\')
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, token: Column) -> Column:
        free = ~s["quoted"]
        depth = s["depth"] + F.when(free & (token == "{"), 1).when(free & (token == "}"), -1).otherwise(0)
        at = s["at"] + F.length(token)
        end = F.when((s["end"] == 0) & free & (token == "}") & (depth <= 0), at).otherwise(s["end"])
        return F.struct(depth.alias("depth"), (s["quoted"] != (token == '"')).alias("quoted"), at.alias("at"), end.alias("end"))

    closed = F.when(text.rlike(r"\A\s*\{"), F.aggregate(tokens, start, step, lambda s: s["end"]))
    at = let(closed, lambda i: F.when((i > 0) & F.try_parse_json(F.left(text, i)).isNotNull(), i))

    def body(i: Column) -> Column:
        head = F.left(text, i)
        rest = strip(F.substr(text, i + 1))
        own = F.coalesce(F.nullif(F.get_json_object(head, "$.output"), F.lit("")), F.nullif(F.get_json_object(head, "$.generated_text"), F.lit("")))
        after = strip(F.regexp_extract(text, rf"\}}{_S}+([\s\S]*)\z", 1))
        return F.when(i.isNotNull(), F.coalesce(F.nullif(rest, F.lit("")), own)).when(text.rlike(rf"\}}{_S}+"), after).otherwise(text)

    return let(at, body)
