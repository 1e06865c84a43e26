"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exceptions."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, read

#: The lexicon is learnt from so many labelled documents of each class at most, taken by a hash.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
PREFIXES = range(4, 9)
MIN_DOCS, MIN_G2, MIN_RATIO = 4, 25.0, 6.0

# Letters of other scripts by the Latin letter that they look like (after decomposition, in lower case).
_LOOKALIKE = {
    "а": "a", "б": "b", "в": "b", "г": "g", "д": "d", "е": "e", "з": "e", "и": "i", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ь": "b", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "є": "e", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "զ": "q", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l",
    "ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t",
}
_DIGITS = dict(zip("013457@$", "oieast" + "as", strict=True))
_OTHER = {c: " " for c in map(chr, range(128)) if not c.isalnum() and c not in _DIGITS}
_NONE = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
_TABLE = str.maketrans({**_OTHER, **_LOOKALIKE, **_DIGITS}) | _NONE


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digit substitutions as Latin letters, punctuation as spaces, blanks at the ends.

    Compatible forms are decomposed first (full width, ligatures, accents), so composed and decomposed letters fold
    alike, and what is folded folds to itself.
    """
    plain = text or ""
    if not plain.isascii():
        plain = unicodedata.normalize("NFKD", plain.lower())
    return " " + " ".join(plain.lower().translate(_TABLE).split()) + " "


@dataclass
class Lexicon:
    #: term -> (weight, stem): a stem fits every word that begins with it
    terms: dict[str, tuple[float, bool]] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: bias, weight of the hits, weight of their density
    model: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    @lru_cache(maxsize=1)  # noqa: B019
    def machine(self):
        found = ahocorasick.Automaton()
        for term, (_, stem) in self.terms.items():
            found.add_word(" " + term + ("" if stem else " "), term)
        found.make_automaton() if self.terms else None
        return found

    def __hash__(self) -> int:
        return id(self)

    def hits(self, folded: str) -> Iterator[tuple[str, str, str, str]]:
        """Term, word before, word and word after, once for each word hit: the heaviest term counts."""
        if not self.terms:
            return
        best: dict[int, str] = {}
        for end, term in self.machine().iter(folded):
            at = end - len(term) + (1 if self.terms[term][1] else 0)
            if at not in best or self.terms[term][0] > self.terms[best[at]][0]:
                best[at] = term
        for at, term in best.items():
            stop = folded.index(" ", at)
            before = folded[folded.rfind(" ", 0, at - 1) + 1 : at - 1] if at > 1 else ""
            after = folded[stop + 1 : max(folded.find(" ", stop + 1), stop + 1)]
            yield term, before, folded[at:stop], after

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = 0.0
        for term, before, word, after in self.hits(folded):
            if self.exceptions and (f"{before} {word}" in self.exceptions or f"{word} {after}" in self.exceptions):
                continue
            total += self.terms[term][0]
        n = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100 * total / max(n, 20))

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        b, p, q = self.model
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, b + p * x + q * y))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
    )
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    one = known.filter("label = 1").orderBy(order).limit(MAX_TOXIC)
    two = known.filter("label = 0").orderBy(order).limit(MAX_CLEAN)
    some = one.unionByName(two).select(F.col("doc_id").alias("_id"), "label")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return cut(own.join(F.broadcast(some), "_id").select("text", "label"))


def _counted(make):
    """Counts of keys by class, summed within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[label].update(make(text))
            keys = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, "string"), pa.array([by[1][k] for k in keys], "int64"), pa.array([by[0][k] for k in keys], "int64")],
                ["key", "t", "c"],
            )

    return run


def _candidates(text: str | None) -> set[str]:
    ws = set(fold(text).split())
    return {w + " " for w in ws if len(w) >= 2} | {w[:n] for w in ws for n in PREFIXES if len(w) >= n}


def _g2(t: int, c: int, n_t: int, n_c: int) -> float:
    n, total = t + c, n_t + n_c
    return 2 * sum(o * math.log(o * total / (n * m)) for o, m in ((t, n_t), (c, n_c)) if o)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Terms, exceptions and calibration from labelled rows that are not held out.

    The sample bounds what is counted, and so the lexicon; null ids and labels other than 0 and 1 teach nothing; without
    rows of both labels the lexicon is empty and every score low; labels of one id that differ count as 1.
    """
    sample = _sample(docs, labels, id_col, text_col)
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_t, n_c = n.get(1, 0), n.get(0, 0)
    lex = Lexicon()
    if not n_t or not n_c:
        return lex
    count = lambda make: sample.mapInArrow(_counted(make), "key string, t long, c long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = ((F.col("t") + 0.5) / (n_t + 1)) / ((F.col("c") + 0.5) / (n_c + 1))
    rows = count(_candidates).filter((F.col("t") >= MIN_DOCS) & (ratio >= MIN_RATIO)).collect()
    found = {r["key"]: (r["t"], r["c"]) for r in rows if _g2(r["t"], r["c"], n_t, n_c) >= MIN_G2}
    # A stem gives way to a longer one, or to a word, with nearly the same documents; then the shorter stem covers the rest.
    best: dict[str, int] = {}
    for k, (t, _) in found.items():
        for m in PREFIXES:
            if m < len(k):
                best[k[:m]] = max(best.get(k[:m], 0), t)
    kept = {k: v for k, v in found.items() if best.get(k, 0) < 0.9 * v[0]}
    weight = lambda t, c: math.log(((t + 0.5) / (n_t + 1)) / ((c + 0.5) / (n_c + 1)))
    terms: dict[str, tuple[float, bool]] = {}
    for k in sorted(kept, key=lambda k: (len(k.strip()), k)):
        if not any(k[:m] in terms and terms[k[:m]][1] for m in PREFIXES if m < len(k)):
            terms[k.strip()] = (weight(*kept[k]), not k.endswith(" "))
    lex = Lexicon(dict(sorted(terms.items(), key=lambda x: (-x[1][0], x[0]))))

    def phrases(text: str | None, lex=lex) -> set[str]:
        hits = [h[1:] for h in lex.hits(fold(text))]
        return {f"{b} {w}" for b, w, _ in hits if b} | {f"{w} {a}" for _, w, a in hits if a}

    rows = count(phrases).filter(F.col("c") >= MIN_DOCS).filter(ratio < 0.5).collect()
    lex = Lexicon(lex.terms, frozenset(r["key"] for r in rows if _g2(r["t"], r["c"], n_t, n_c) >= 10))

    def measure(batches, lex=lex):
        for batch in batches:
            xy = [lex.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in xy], "float64"), pa.array([y for _, y in xy], "float64"), batch.column(1)], ["x", "y", "label"]
            )

    pairs = sample.mapInArrow(measure, "x double, y double, label int").collect()  # as many rows as the sample has at most
    lex.model = _logistic(np.array([[1, r["x"], r["y"]] for r in pairs]), np.array([r["label"] for r in pairs], float))
    return lex


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1]), x.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, a double from 0 to 1; a null text is scored as empty."""
    names = [c for c in docs.columns if c != into]
    schema = docs.select(names).schema.add(into, "double")
    at = names.index(text_col)
    lex = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lex.value
        for batch in batches:
            s = pa.array([own.score(t.as_py()) for t in batch.column(at)], "float64")
            yield pa.RecordBatch.from_arrays([*batch.columns, s], [*names, into])

    return docs.select(names).mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids count as held out; repeated rows score alike; empty tables give an empty result."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
