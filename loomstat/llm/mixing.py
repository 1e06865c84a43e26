"""Mixing to target weights: raking of token weights to source, language and topic shares, then sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, free, read, store

#: Target shares are the observed ones to these powers, normalised: below 1 lifts what is rare.
POWERS = {"source": 0.5, "lang": 0.6, "topic": 0.8}
#: Expected share of all tokens that the sample keeps.
FRACTION = 0.5
#: Error of a share that is met; sweeps in a job; sweeps without a thousandth of progress that tell unreachable targets.
TOLERANCE, SWEEPS, STALLED = 1e-3, 8, 16
#: Cells that a task rakes; more are dealt over several.
CELLS_A_TASK = 1_000_000
SEED = 17
#: Stands for null values of a dimension.
NULL = "∅"

Targets = dict[str, dict[str, float]]


def n_tokens(text: Column) -> Column:
    """Words, and one for a text without any, so that every document weighs something."""
    t = F.coalesce(text, F.lit(""))
    # blanks are one byte: ends of words are counted without building the words
    return F.greatest(F.size(F.split(F.trim(F.regexp_replace(t, SPACE, " ")), " ")), F.lit(1)).cast("long")


def topic(text: Column) -> Column:
    """A topic by form, for documents without a topic column: legal, table, markup, shouting, or prose by length."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", "")) / n
    low = F.lower(t)
    legal = (low.contains("licen") & low.rlike("licen[sc]ed? under")) | low.contains("copyright") | low.contains("all rights reserved") | low.contains("spdx-")
    return (
        F.when(legal, "legal")
        .when(share(r"|\t") > 0.02, "table")
        .when(share("#*$%&<>{}") > 0.05, "markup")
        .when(share("A-Z") > 0.3, "shouting")
        .when(n < 1000, "short")
        .when(n < 5000, "prose")
        .otherwise("long")
    )


def dimensions(docs: DataFrame, text_col: str, topic_of: Callable[[Column], Column]) -> dict[str, Column]:
    """Source, language and topic as strings, nulls as a value of their own; a ``topic`` column of the table is used."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL)) if c in docs.columns else F.lit(NULL)
    own = known("topic") if "topic" in docs.columns else F.coalesce(topic_of(F.col(text_col)), F.lit(NULL))
    return {"source": known("source"), "lang": known("lang"), "topic": own}


def fill(marginal: DataFrame, wanted: float) -> float:
    """The scale at which values (``share``, at most the tokens ``n`` they have) fill ``wanted`` tokens."""
    scale, full = 0.0, -1
    while True:
        free_ = F.col("share") * scale < F.col("n")
        s = marginal.agg(
            F.sum(F.when(~free_, F.col("n")).otherwise(0)).alias("full"), F.sum(F.when(free_, F.col("share")).otherwise(0.0)).alias("free")
        ).first()
        if s["full"] == full or not s["free"]:
            return scale
        full = s["full"]
        scale = max(scale, (wanted - full) / s["free"])


def aims(cells: DataFrame, dim: str, power: float, targets: dict[str, float] | None, wanted: float) -> DataFrame:
    """``dim`` and the tokens that each of its values is to have (column ``t_`` and the name).

    Shares named in ``targets`` hold; the other values share the rest by the power of what is observed.  A value
    with fewer tokens than its share gives all it has, and the rest is shared by the others.
    """
    marginal = cut(cells.groupBy(dim).agg(F.sum("n").alias("n")).withColumn("p", F.pow("n", F.lit(power))))
    named = F.create_map(*[F.lit(x) for k, v in (targets or {}).items() for x in (k, float(v))]) if targets else None
    told = named[F.col(dim)] if targets else F.lit(None).cast("double")
    s = marginal.agg(F.sum(F.when(told.isNull(), F.col("p"))).alias("p"), F.sum(told).alias("told")).first()
    rest = max(0.0, 1 - (s["told"] or 0.0))
    share = F.coalesce(told, F.col("p") / F.lit(s["p"] or 1.0) * rest)
    marginal = marginal.withColumn("share", share)
    return marginal.select(dim, F.least(F.col("n").cast("double"), F.col("share") * fill(marginal, wanted)).alias(f"t_{dim}"))


def rake(cells: DataFrame, dims: list[str], *, stalled: int = STALLED, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` with ``w``, the tokens kept of each, and the largest relative error of a marginal.

    ``cells`` has the dimensions, ``n``, a start ``w`` and the aims ``t_``.  A step scales the cells of a value to its
    aim, each to ``n`` at most; sweeps go on until every aim is met, or until the error has not fallen by a thousandth
    in ``stalled`` sweeps, which tells aims that empty or full combinations put out of reach.  Sums are windows over
    the cells, never joins with their own aggregate, so a plan grows with the sweeps of a job alone.  Cells that one task
    can have are one part, and no window shuffles them.
    """
    parts = max(1, -(-cells.count() // CELLS_A_TASK))
    cells = cut(cells.coalesce(parts))
    best, since, nearest = float("inf"), 0, cells
    while True:
        # told anew, as a written table does not say that it is one part
        out, rest = cells.coalesce(1) if parts == 1 else cells, [c for c in cells.columns if c != "w"]
        for _ in range(SWEEPS):
            for d in dims:
                scaled = F.col("w") * F.col(f"t_{d}") / F.sum("w").over(Window.partitionBy(d))
                out = out.select(*rest, F.least(F.col("n").cast("double"), scaled).alias("w"))
        off = F.greatest(*[F.abs(F.sum("w").over(Window.partitionBy(d)) / F.col(f"t_{d}") - 1) for d in dims], F.lit(0.0))
        cells = cut(out.withColumn("off", off))
        error = cells.agg(F.max("off")).first()[0]
        cells = cells.drop("off")
        best, since, nearest = (error, 0, cells) if error < 0.999 * best else (best, since + SWEEPS, nearest)
        if best <= tolerance or since >= stalled:
            return nearest, best


def rates(dims: DataFrame, names: dict[str, str], powers: dict[str, float], targets: Targets | None, fraction: float, tokens: str) -> DataFrame:
    """A row for each cell of the dimensions (columns ``names``): ``weight``, ``probability`` and ``residual``.

    The residual is the largest relative error that a marginal is left with, the same in all rows.  The table is
    written, so that its size is known: joins send it where it is small, and shuffle it where it is not.
    """
    cells = cut(dims.groupBy(*names.values()).agg(F.sum(tokens).alias("n")).select(*[F.col(c).alias(d) for d, c in names.items()], "n"))
    total = cells.agg(F.sum("n")).first()[0]
    if not total:
        raked, residual = cells.withColumn("w", F.lit(0.0)), 0.0
    else:
        start = cells.withColumn("w", F.col("n") * F.lit(fraction))
        for d in names:
            start = start.join(store(aims(cells, d, powers[d], (targets or {}).get(d), fraction * total)), d)
        raked, residual = rake(start, list(names))
    rate = F.col("w") / F.col("n")
    return store(
        raked.select(
            *[F.col(d).alias(c) for d, c in names.items()], (rate / F.lit(fraction)).alias("weight"), F.least(rate, F.lit(1.0)).alias("probability"), F.lit(residual).alias("residual")
        )
    )


def draw(id_col: str, content: list[str], seed: int = SEED) -> Column:
    """A number from 0 to 1 that is the same in every run: by the id of a row, else by its content."""
    own = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))).otherwise(F.xxhash64(F.lit(~seed), *content))
    return F.shiftrightunsigned(own, 11) / F.lit(float(1 << 53))


def _content(docs: DataFrame, text_col: str) -> list[str]:
    return [text_col, *[c for c in ("source", "lang", "topic") if c in docs.columns]]


def mix(
    docs: DataFrame,
    *,
    targets: Targets | None = None,
    powers: dict[str, float] = POWERS,
    fraction: float = FRACTION,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic_of: Callable[[Column], Column] = topic,
) -> DataFrame:
    """Id, dimensions, ``n_tokens``, ``weight``, ``probability``, ``sampled`` and ``residual`` of each document.

    ``targets`` gives shares of all tokens by dimension (``source``, ``lang``, ``topic``) and value; what it leaves
    open follows ``powers``.  Null sources and languages are a value of their own; null, empty and wordless texts
    count one token; rows that share an id are drawn together, rows without id one by one by what they hold (equal ones
    together); an empty table gives an empty result; other columns are not read.  ``residual`` tells how far the
    marginals are from what was aimed at.
    """
    names = {"source": "source", "lang": "lang", "topic": "topic"}
    own = dimensions(docs, text_col, topic_of)
    drawn = draw(id_col, _content(docs, text_col), seed)
    dims = cut(docs.select(F.col(id_col).alias("id"), *[c.alias(d) for d, c in own.items()], n_tokens(F.col(text_col)).alias("n_tokens"), drawn.alias("drawn")))
    out = dims.join(rates(dims, names, powers, targets, fraction, "n_tokens"), list(names))
    return out.select(
        F.col("id").alias(id_col), *names, "n_tokens", "weight", "probability", (F.col("drawn") < F.col("probability")).alias("sampled"), "residual"
    )


def sample(
    docs: DataFrame,
    *,
    targets: Targets | None = None,
    powers: dict[str, float] = POWERS,
    fraction: float = FRACTION,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic_of: Callable[[Column], Column] = topic,
) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they were, whatever their names; else as :func:`mix`."""
    own = dimensions(docs, text_col, topic_of)
    names = free(docs, *own)
    tokens, weight, probability, residual = free(docs, "tokens", "weight", "probability", "residual").values()
    dims = docs.withColumns({names[d]: c for d, c in own.items()})
    cells = rates(dims.withColumn(tokens, n_tokens(F.col(text_col))), names, powers, targets, fraction, tokens)
    cells = cells.withColumnsRenamed({"weight": weight, "probability": probability, "residual": residual})
    return dims.join(cells, list(names.values())).filter(draw(id_col, _content(docs, text_col), seed) < F.col(probability)).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mix` of ``documents``: nulls, empty texts, ties, repeated rows and empty tables as told there."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}
