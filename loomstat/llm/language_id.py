"""Language by cross-parsing entropy: suffix automata of labelled text give longest matches; fewest phrases win."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, read, store

#: Learning reads, for each language, the document of least hash in each of BUCKETS buckets, CHARS characters of each.
BUCKETS, CHARS = 64, 1500
#: Symbols of a reference text at most.  Its tables are some 2 MB; so many languages are sent at a time.
REFERENCE, LANGS_A_PASS = 60_000, 32
#: Texts are parsed side by side in segments of so many symbols; the state goes on from one to the next.
SEGMENT = 1024
#: Symbols that are held at once: longer texts go on where the last ones stopped.
SYMBOLS = 4_000_000
SPACE, OTHER = 0, 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def code_table(letters: np.ndarray) -> np.ndarray:
    """Symbols of code points: every letter of a reference text has its own, from 2."""
    table = np.where(_letters(), OTHER, SPACE).astype("i4")
    table[letters] = np.arange(2, len(letters) + 2)
    return table


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Every run of what are not letters is one space."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    return codes[keep]


@dataclass
class Automaton:
    """The suffix automaton of a text: edges share one array, in which those of a state lie at its base plus the symbol."""

    size: int  # symbols of the text
    base: np.ndarray  # by state
    slots: np.ndarray  # state << 32 | next state
    root: np.ndarray  # next state of a phrase that begins with a symbol

    @property
    def dead(self) -> int:
        """The state before a text, and after a symbol that the reference lacks: it has no edges."""
        return len(self.base) - 1

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether a phrase begins with the symbols."""
        slot = self.slots[self.base[state] + symbol]
        begins = slot >> 32 != state
        return np.where(begins, self.root[symbol], slot & 0xFFFFFFFF), begins


def automaton(symbols: np.ndarray, n_symbols: int) -> Automaton:
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    dead = len(edges)
    root = np.full(n_symbols, dead, "i8")
    for c, to in edges[0].items():
        root[c] = to
    # states of several edges take the first place that fits; those of one edge fill what is free
    total = sum(map(len, edges))
    used = bytearray(2 * total + 4 * n_symbols + 64)
    base = np.zeros(dead + 1, "i8")
    hint = n_symbols
    for i in sorted((i for i in range(1, dead) if len(edges[i]) > 1), key=lambda i: -len(edges[i])):
        own = sorted(edges[i])
        hint = used.index(0, hint)
        at, tries = hint, 0
        while any(used[at - own[0] + c] for c in own):
            tries += 1
            at = used.index(0, at + 1) if tries < 100 else used.rindex(1) + 1
        for c in own:
            used[at - own[0] + c] = 1
        base[i] = at - own[0]
        if len(used) < at + 2 * n_symbols + 64:
            used.extend(bytes(len(used)))
    one = np.array([i for i in range(1, dead) if len(edges[i]) == 1], "i8")
    first = np.array([next(iter(edges[i])) for i in one], "i8")
    free = np.flatnonzero(np.frombuffer(bytes(used), "u1")[n_symbols:] == 0) + n_symbols
    if len(free) < len(one):
        free = np.concatenate([free, len(used) + np.arange(len(one) - len(free))])
    base[one] = free[: len(one)] - first
    slots = np.full(int(base.max()) + n_symbols + 1, -1, "i8")
    for i in range(1, dead):
        for c, to in edges[i].items():
            slots[base[i] + c] = i << 32 | to
    return Automaton(len(symbols), base, slots, root)


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``lang``, ``least``, ``text``: what is learnt from.  Which rows are read depends on their text alone."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    h = F.xxhash64(text_col)
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.shiftrightunsigned(h, 1).alias("h"), F.pmod(h, F.lit(BUCKETS)).alias("b"))
    # BUCKETS rows for each language; equal texts share a hash, so one of them is enough
    own = known.groupBy("lang", "b").agg(F.min(F.struct("h", F.substring("text", 1, CHARS).alias("text"))).alias("x"))
    return cut(own.select("lang", F.col("x.h").alias("least"), F.col("x.text").alias("text")))


@dataclass
class Models:
    """Languages, letters that have a symbol of their own, and a row with an automaton for each language."""

    langs: list[str]
    letters: np.ndarray
    rows: DataFrame | None

    def load(self, langs: list[str]) -> list[Automaton]:
        found = self.rows.filter(F.col("lang").isin(langs)).orderBy("lang").toArrow().to_pylist()
        return [Automaton(r["size"], *[np.frombuffer(r[c], "i8") for c in ("base", "slots", "root")]) for r in found]


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """From text and language of rows that are not held out.  Automata are built in tasks, one for each language."""
    some = _sample(docs, id_col, text_col, lang_col)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(sys.maxunicode + 1, bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen[_points(t)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen & _letters()), "int32")], ["c"])

    letters = np.sort(some.select("text").mapInArrow(points, "c int").distinct().toArrow()["c"].to_numpy())  # of all letters that there are

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("least")
        codes = code_table(letters)
        a = automaton(_symbols(codes[_points(" ".join(table["text"].to_pylist()))])[:REFERENCE], len(letters) + 2)
        return pa.table({"lang": table["lang"][:1], "size": [a.size], "base": [a.base.tobytes()], "slots": [a.slots.tobytes()], "root": [a.root.tobytes()]})

    built = store(some.groupBy("lang").applyInArrow(build, "lang string, size long, base binary, slots binary, root binary"))
    return Models([r["lang"] for r in built.select("lang").orderBy("lang").collect()], letters, built)


def phrases(a: Automaton, texts: list[np.ndarray], starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many phrases begin in each text (as symbols), and the states after them; ``starts`` are those before them.

    Segments are parsed side by side, as if a phrase began with each.  Then every segment is parsed again from the state
    that the one before it ended in, until it is in the state that it was in at that place, which is soon.
    """
    n_parts = np.array([-(-len(t) // SEGMENT) for t in texts], "i8")
    starts = np.full(len(texts), a.dead) if starts is None else starts
    total, ends = np.zeros(len(texts), "i8"), starts.copy()
    if not n_parts.sum():
        return total, ends
    owner = np.repeat(np.arange(len(texts)), n_parts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    sizes = np.minimum(np.array([len(t) for t in texts], "i8")[owner] - place * SEGMENT, SEGMENT)
    order = np.argsort(-sizes, kind="stable")
    column = np.empty(len(order), "i8")
    column[order] = np.arange(len(order))
    grid = np.zeros((int(sizes.max()), len(order)), "i4")
    for part, col in enumerate(column.tolist()):
        t = texts[owner[part]]
        at = place[part] * SEGMENT
        grid[: sizes[part], col] = t[at : at + SEGMENT]
    last_part = np.cumsum(n_parts)[n_parts > 0] - 1
    after = np.full(len(order), -1, "i8")  # by column: that of the next segment
    inner = np.flatnonzero(place > 0)
    after[column[inner - 1]] = column[inner]
    before = np.full(len(order), -1, "i8")
    before[column[inner]] = column[inner - 1]
    size = sizes[order]
    live = np.searchsorted(-size, -np.arange(1, grid.shape[0] + 1), side="right")
    state = np.full(len(order), a.dead, "i8")
    heads = np.flatnonzero(place == 0)
    state[column[heads]] = starts[owner[heads]]
    trace, begins = np.empty(grid.shape, "i4"), np.zeros(grid.shape, bool)
    for step, k in enumerate(live.tolist()):
        state[:k], begins[step, :k] = a.step(state[:k], grid[step, :k])
        trace[step, :k] = state[:k]
    todo = column[inner]
    while len(todo):
        cols, state = todo, trace[size[before[todo]] - 1, before[todo]].astype("i8")
        changed, step = [], 0
        while len(cols):
            new, began = a.step(state, grid[step, cols])
            open_ = new != trace[step, cols]
            trace[step, cols], begins[step, cols] = new, began
            step += 1
            done = open_ & (size[cols] == step)  # never met: the segment after it begins anew
            changed.append(after[cols[done]])
            cols, state = cols[open_ & ~done], new[open_ & ~done]
        todo = np.concatenate(changed)
        todo = todo[todo >= 0]
    np.add.at(total, owner, begins.sum(axis=0, dtype="i8")[column])
    final = column[last_part]
    ends[n_parts > 0] = trace[size[final] - 1, final]
    return total, ends


def _counts(automata: list[Automaton], texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of texts by language, some millions of symbols at a time."""
    out = np.zeros((len(texts), len(automata)), "i8")
    group: list[int] = []
    held = 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or held + len(t) > SYMBOLS):
            for k, a in enumerate(automata):
                out[group, k] = phrases(a, [texts[g] for g in group])[0]
            group, held = [], 0
        if t is None:
            break
        if len(t) > SYMBOLS:
            for k, a in enumerate(automata):
                state = None
                for at in range(0, len(t), SYMBOLS):
                    n, state = phrases(a, [t[at : at + SYMBOLS]], state)
                    out[i, k] += n[0]
        else:
            group.append(i)
            held += len(t)
    return out


def predict(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text", langs_a_pass: int = LANGS_A_PASS) -> DataFrame:
    """Id, ``lang_pred`` and ``score`` (0 to 1) of each row.

    The phrases of a text are weighted by the size of the reference and divided by the text's length.  Some languages
    are sent at a time; with more of them, what is known of each row is written between passes.

    ``und`` with score 0 for null texts, texts without a letter, and where no language was learnt; ties go to the
    first language by name; null ids pass; repeated rows are predicted alike; texts of any length are parsed whole;
    an empty table gives an empty result; other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    letters = models.letters
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(float("inf")).alias("best"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("total"))

    def parse(langs: list[str], sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = code_table(letters)
            automata = sent.value
            bits = np.log2(np.maximum([a.size for a in automata], 2))
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    texts = [_symbols(codes[_points(t)]) if t else np.empty(0, "i4") for t in batch.column(1).to_pylist()]
                    lettered = np.array([bool((t != SPACE).any()) for t in texts])
                    n = np.maximum([len(t) for t in texts], 1)
                    entropy = _counts(automata, texts) * bits / n[:, None]
                    best, names = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
                    winner = entropy.argmin(axis=1)
                    least = entropy.min(axis=1)
                    names = [langs[w] if ok and x < b else name for w, ok, x, b, name in zip(winner, lettered, least, best, names, strict=True)]
                    total = batch.column(4).to_numpy(zero_copy_only=False) + np.exp(-4 * entropy).sum(axis=1)
                    best = np.where(lettered, np.minimum(best, least), best)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(names, "string"), pa.array(total)], whole.schema.names)

        return run

    passes = range(0, len(models.langs), langs_a_pass)
    for at in passes:
        langs = models.langs[at : at + langs_a_pass]
        sent = sc.broadcast(models.load(langs))
        rows = rows.mapInArrow(parse(langs, sent), "doc_id long, text string, best double, lang_pred string, total double")
        if at != passes[-1]:
            rows = store(rows)
            sent.unpersist()
    score = F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.least(F.exp(F.lit(-4.0) * F.col("best")) / F.col("total"), F.lit(1.0)))
    return rows.select("doc_id", "lang_pred", F.when(F.col("best") == float("inf"), 0.0).otherwise(score).alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`predict` of all ``documents``, learnt from those that are not held out; nulls, ties, long texts and empty tables as told there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
