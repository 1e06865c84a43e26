"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, read, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that with for was on as by from at are be this not or "
    "le la les de des et est un une du que en pour dans pas sur au par "
    "el los las y un una por con para su al lo como se del "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als"
).split()
#: EM stops after this many rounds, or when no parameter moves by more than TOLERANCE.
ROUNDS, TOLERANCE = 25, 1e-4
SMOOTHING = 1.0
#: A word of letters alone, with what may stand around it.
PLAIN = r"^[(\"'«¿¡]*\p{L}[\p{L}\p{M}'’-]*[.,;:!?)\"'»]*\z"
KEEP_AT = 0.5


def n_repeat_words(ws: Column) -> Column:
    """Words in windows of eight words that the text holds twice or more, first ones included."""
    n = F.size(ws)

    def covered(win: Column) -> Column:
        tagged = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

        at = F.array_sort(F.transform(let(tagged, repeated), lambda x: x["i"]))
        length = lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(at, length))

    windows = lambda hs: F.transform(
        F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW))
    )
    found = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: let(windows(hs), covered))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(found)


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts that base filter and rules use, one row a document; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = let(
        words(F.col(text_col)),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            n_repeat_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
            F.size(F.filter(ws, lambda w: w.rlike(PLAIN))).cast("long").alias("n_plain"),
            F.size(F.filter(ws, lambda w, i: w == F.get(ws, i - 1))).cast("long").alias("n_same"),
            F.size(F.filter(ws, lambda w: w.rlike(r"\p{Lu}\p{Lu}"))).cast("long").alias("n_upper"),
        ),
    )
    line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return (
        docs.select(
            F.col(id_col).alias(id_col),
            own.alias("_w"),
            line.alias("_l"),
            F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        )
        .select(
            id_col,
            "_w.n_words",
            "word_chars",
            "n_symbols",
            (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
            "_w.n_repeat_words",
            "_w.n_stop",
            "_w.n_plain",
            "_w.n_same",
            "_w.n_upper",
            "n_letters",
            F.col("_l.n").cast("long").alias("n_lines"),
        )
    )


def votes() -> dict[str, Column]:
    """The rules: 1 for good, -1 for bad, 0 to abstain.  What every text has says nothing good of it, so some only find fault."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n

    def rule(good: Column | None, bad: Column) -> Column:
        return F.when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)

    mean = F.col("word_chars") / n
    letters = F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": rule(n >= 60, n < 30),
        "word_length": rule(None, (mean < 2) | (mean > 15)),
        "symbols": rule(F.col("n_symbols") <= 0.02 * n, F.col("n_symbols") > 0.1 * n),
        "repeats": rule(None, share("n_repeat_words") > 0.2),
        "dup_lines": rule(None, F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "stop_words": rule(share("n_stop") >= 0.06, share("n_stop") < 0.02),
        "plain_words": rule(share("n_plain") >= 0.9, share("n_plain") < 0.7),
        "upper_case": rule(None, share("n_upper") > 0.4),
        "letters": rule(letters >= 0.9, letters < 0.8),
        "same_words": rule(None, share("n_same") > 0.2),
    }


Model = tuple[float, dict[str, dict[int, tuple[float, float]]]]


def posterior(model: Model) -> Column:
    """Probability of good quality given the votes, from P(vote | good) and P(vote | bad) of each rule, abstaining being a third vote."""
    prior, rules = model
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, by in rules.items():
        step = F.lit(0.0)
        for v, (good, bad) in by.items():
            if v:  # who abstains says nothing
                step = F.when(F.col(f"v_{name}") == v, math.log(good / bad)).otherwise(step)
        odds = odds + step
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame) -> Model:
    """EM over the table of vote patterns (3 ** rules at most, with their counts over all documents)."""
    names = [c[2:] for c in voted.columns if c.startswith("v_")]
    patterns = cut(voted.groupBy(*[f"v_{x}" for x in names]).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    total = sum((F.col(f"v_{x}") for x in names[1:]), F.col(f"v_{names[0]}"))
    belief = F.when(total > 0, 0.9).when(total < 0, 0.1).otherwise(0.5)  # a majority starts it
    model: Model | None = None
    for _ in range(ROUNDS):
        g, b = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
        sums = [F.sum(g).alias("good"), F.sum(b).alias("bad")]
        for x in names:
            for v in (-1, 1):
                here = F.col(f"v_{x}") == v
                sums += [F.sum(F.when(here, g)).alias(f"g{v}_{x}"), F.sum(F.when(here, b)).alias(f"b{v}_{x}")]
        s = patterns.withColumn("q", belief).agg(*sums).first().asDict()
        s = {k: v or 0.0 for k, v in s.items()}
        prior = (s["good"] + SMOOTHING) / (s["good"] + s["bad"] + 2 * SMOOTHING)
        rules = {}
        for x in names:
            by = {}
            for v in (-1, 1):
                good, bad = ((s[f"{kind}{v}_{x}"] + SMOOTHING) / (s[of] + 3 * SMOOTHING) for kind, of in (("g", "good"), ("b", "bad")))
                # A rule is never believed to point the wrong way.
                by[v] = (good, min(good, bad)) if v == 1 else (min(good, bad), bad)
            rules[x] = by
        last, model = model, (prior, rules)
        if last and _moved(last, model) < TOLERANCE:
            break
        belief = posterior(model)
    return model


def _moved(a: Model, b: Model) -> float:
    return max(
        [abs(a[0] - b[0])]
        + [abs(a[1][x][v][k] - b[1][x][v][k]) for x in a[1] for v in (-1, 1) for k in (0, 1)]
    )


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base filter, votes, posterior ``quality`` and ``kept`` for each document.

    The model learns from all documents that pass the base filter.  Null and empty texts have zero counts and fail
    the base filter; null ids pass through; repeated rows are judged alike; other columns are not read; an empty
    table gives an empty result.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    f = features(docs, id_col=id_col, text_col=text_col).withColumn("base_failed", failed)
    voted = cut(f.select("*", *[v.alias(f"v_{k}") for k, v in votes().items()]))
    model = fit(voted.filter(~F.col("base_failed")))
    quality = posterior(model)
    return voted.select(
        *f.columns[:6],
        "base_failed",
        (~F.col("base_failed") & (quality >= KEEP_AT)).alias("kept"),
        quality.alias("quality"),
        *[c for c in voted.columns if c.startswith("v_")],
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`judge` of ``documents``; nulls, ties, repeated rows and empty tables as told there."""
    return judge(read(spark, sf_dir, "documents"))


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
