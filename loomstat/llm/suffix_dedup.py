"""Exact removal of repeated byte strings with a run-length index (run-compressed Burrows-Wheeler transform).

A string of ``LENGTH`` bytes is repeated when it starts at two places of the corpus.  One task cannot index the
corpus, so its windows are first dealt out by content:

1. every window has one anchor, the least hash among its 64-byte grams; windows with one anchor stand side by side.
   A window can only repeat where its anchor does, so anchors that occur once need no index.
2. the windows of an anchor and what they cover are a snippet.  Equal snippets of an anchor are one phrase with a
   count, as in prefix-free parsing: all of them are in the index at the cost of one.
3. each index is the run-compressed BWT of a batch of phrases with suffix-array samples at both ends of its runs.
   Between samples a position keeps its neighbour in suffix order and its match shrinks by one, so matching
   statistics of the batch against itself stream from the samples alone; windows matching ``LENGTH`` are marked.
4. an anchor whose phrases would not fit an index (a line in a third of all documents) is dealt out again by longer
   grams of its windows, in the end by the windows themselves, and so indexed in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, store, text_key

LENGTH = 200
#: Bytes of the grams that deal windows out, and of those that deal crowded anchors out again; the last are windows.
GRAM = 64
LONGER = (128, LENGTH)
#: Bytes of snippets that fill an index, which takes whole anchors; anchors with more than the second are dealt out again.
INDEX_BYTES, CROWDED_BYTES = 1 << 18, 1 << 20
#: One row in so many tells where anchors are cut into partitions; results do not depend on it.
LOOK_AT = 64
#: Rows of snippets that are given on together, and a text's more at most.
ROWS = 1 << 15
#: Bytes that are looked at together for anchors; a text's windows are dealt out in parts of this size.
PART = 1 << 20
_POSITION = np.uint64((1 << 22) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _grams(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place; ``b`` is uint64."""
    h, base, step = (b + np.uint64(1)) * _MIX, _ODD, 1  # of ``step`` bytes, and the base to that power
    out, done = None, 0
    while True:
        if gram & step:
            out = h if out is None else out[: len(b) - done - step + 1] * base + h[done : len(b) - step + 1]
            done += step
        if done == gram:
            break
        h, base, step = h[:-step] * base + h[step:], base * base, 2 * step
    out = out ^ (out >> np.uint64(32))
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first and last window start of each anchor; ``data`` is uint8 and shorter than 2 ** 22."""
    n = len(data) - length + 1
    with np.errstate(over="ignore"):
        h = _grams(data.astype("u8"), gram)
    least = (h & ~_POSITION) | np.arange(len(h), dtype="u8")
    span, reach = length - gram + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: -(span - reach)], least[span - reach :])
    at = (least[:n] & _POSITION).astype("i8")
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], n) - 1
    return h[at[first]].view("i8"), first, last


def _snippets(length: int, bounds: list[int]):
    """Rows ``a`` (anchor), ``s`` (snippet hash), ``k1``, ``k2`` (text), ``lo``, ``hi`` (window starts), ``part``.

    An anchor goes to the partition between its bounds; one that spans several is dealt over them by the row's salt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, names = np.array(bounds, "i8"), ["a", "s", "k1", "k2", "lo", "hi", "part"]

        def together(cols: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names)

        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            keys = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for k1, k2, salt, text in zip(*keys, batch.column(2), strict=True):
                raw = text.as_buffer()
                if raw is None or raw.size < length:
                    continue
                data = np.frombuffer(raw, "u1")
                for at in range(0, len(data) - length + 1, PART):
                    a, lo, hi = anchors(data[at : at + PART + length - 1], length)
                    lo, hi = lo + at, hi + at
                    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
                    s = np.array([digest(view[i : j + length]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], "u8")
                    m, low = len(a), np.searchsorted(cuts, a, "left")
                    part = low + salt // LOOK_AT % (np.searchsorted(cuts, a, "right") - low + 1)
                    held.append((a, s.view("i8"), np.full(m, k1, "i8"), np.full(m, k2, "i8"), lo.astype("i4"), hi.astype("i4"), part.astype("i4")))
                    size += m
                    if size >= ROWS:
                        yield together(held)
                        held, size = [], 0
            if held:
                yield together(held)

    return run


SNIPPET = "a long, s long, k1 long, k2 long, lo int, hi int"


# --- the run-length index -------------------------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; ``t`` is uint8 and ends are smaller than anything."""
    n = len(t)
    wide = np.zeros(n + 8, "u8")
    wide[:n] = t.astype("u8") + np.uint64(1)
    key = np.zeros(n, "u8")
    for i in range(7):  # seven symbols of nine bits
        key = (key << np.uint64(9)) | wide[i : i + n]
    order = np.argsort(key.view("i8"))
    open_, keys, reach = np.arange(n), key[order], 7
    rank = np.empty(n, "i8")
    while True:
        # A suffix ranks as the first of its equals so far; only suffixes with equals are sorted again.
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        tied = ~(new & np.append(new[1:], True))
        open_ = open_[tied]
        if not len(open_):
            return order
        p = order[open_]
        ahead = p + reach
        keys = rank[p] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(keys)
        order[open_], keys = p[by], keys[by]
        reach *= 2


def eights(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number."""
    padded = np.concatenate([t, np.zeros(8, "u1")])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()


def common_prefix(words: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that agree from places ``p`` and ``q`` of a text (its :func:`eights`), ``most`` at most."""
    n = len(words) - 1
    out = np.zeros(len(p), "i8")
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] + out[live], q[live] + out[live]
        ok = (a < n) & (b < n) & (out[live] < most[live])
        live, a, b = live[ok], a[ok], b[ok]
        x = words[a] ^ words[b]
        out[live] += np.bitwise_count(~x & (x - np.uint64(1))) >> 3  # zeros below the lowest one, in bytes
        live = live[x == 0]
    return np.minimum(out, most)


class RunIndex:
    """Runs of the BWT and suffix-array samples at their ends.

    ``reach`` tells for each place of ``t`` how far the copies of its phrase go on: a phrase with a count stands that
    often side by side in suffix order, which makes runs longer but not more, and each place matches its own copy.
    """

    def __init__(self, t: np.ndarray, reach: np.ndarray | None = None):
        self.t, self.reach = t, np.zeros(len(t), "i8") if reach is None else reach
        sa = suffix_array(t)
        bwt = t[sa - 1]  # cyclic: what stands before the first suffix is the last symbol
        self.heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        tails = np.append(self.heads[1:], len(t)) - 1
        first, last = np.zeros(len(t), bool), np.zeros(len(t), bool)
        first[self.heads] = last[tails] = True
        # The suffix before a run's first and after a run's last; the text's own start is sampled too.
        zero = int(np.flatnonzero(sa == 0)[0])
        first[zero : zero + 2] = last[max(zero - 1, 0) : zero + 1] = True
        above, below = np.flatnonzero(first), np.flatnonzero(last)
        self.up = self._sampled(len(t), sa[above], np.where(above > 0, sa[above - 1], -1))
        self.down = self._sampled(len(t), sa[below], np.where(below + 1 < len(t), sa[np.minimum(below + 1, len(t) - 1)], -1))

    @staticmethod
    def _sampled(n: int, at: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_place = np.full(n, -2)
        by_place[at] = near
        at = np.flatnonzero(by_place > -2)
        return at, by_place[at]

    def matching_statistics(self, most: int) -> np.ndarray:
        """For each place, how far it agrees with some other place (``most`` at least where it is longer)."""
        n = len(self.t)
        out, words = self.reach.copy(), eights(self.t)
        for at, near in (self.up, self.down):
            room = np.diff(np.append(at, n))  # a sample serves the places up to the next one
            length = np.where(near >= 0, common_prefix(words, at, np.maximum(near, 0), room + most), 0)
            own = np.repeat(at + length, room) - np.arange(at[0], n)
            np.maximum(out[at[0] :], own, out=out[at[0] :])
        return out


def repeated_windows(snippets: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """Starts of windows of each (distinct) snippet, which stands for so many, that also start elsewhere in the batch."""
    t = np.frombuffer(b"\xff".join(snippets) + b"\xff", "u1")  # 0xFF is in no UTF-8 text
    reach = np.concatenate([np.append(np.arange(len(s), 0, -1) if n > 1 else np.zeros(len(s), "i8"), 0) for s, n in zip(snippets, counts, strict=True)])
    ms = RunIndex(t, reach).matching_statistics(length)
    out, at = [], 0
    for s in snippets:
        n = len(s) - length + 1
        out.append(np.flatnonzero(ms[at : at + n] >= length))
        at += len(s) + 1
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    if starts[-1] - starts[0] == len(starts) - 1:
        return [(int(starts[0]), int(starts[-1]))]
    cut_ = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut_ + 1)].tolist(), starts[np.append(cut_, len(starts) - 1)].tolist(), strict=True))


MARKS = "a long, s long, lo int, hi int"
PIECE = "a long, s long, n long, snippet binary"


def _index(length: int):
    """Pieces sorted by anchor, in batches of whole anchors, each with one index; marks are places in the piece."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        counts: dict[bytes, int] = {}
        for _, _, n, snippet in rows:
            counts[snippet] = counts.get(snippet, 0) + n
        found = dict(zip(counts, repeated_windows(list(counts), list(counts.values()), length), strict=True))
        out = [(a, s, lo, hi) for a, s, _, snippet in rows for lo, hi in _runs(found[snippet])]
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = ("int64", "int64", "int32", "int32")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "s", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEX_BYTES and held[-1][0] != row[0]:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield marks(held)

    return run


def _cut_out(length: int):
    """What the listed snippets of a text cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, todo in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_buffer()
                view = memoryview(raw)
                out += [(x["a"], x["s"], x["n"], bytes(view[x["lo"] : x["hi"] + length]), x["crowded"]) for x in todo]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = ("int64", "int64", "int64", "binary", "bool")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "s", "n", "snippet", "crowded"])

    return run


def _deal(length: int, gram: int):
    """Snippets of pieces by longer grams: ``a``, ``s`` of the new snippet, ``pa``, ``ps``, ``n`` of the piece, place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pa_, ps, n, snippet in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, lo, hi = anchors(np.frombuffer(snippet, "u1"), length, gram)
                s = np.array([xxhash.xxh3_64_intdigest(snippet[i : j + length]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], "u8")
                m = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(s.view("i8")), *[pa.array(np.full(m, x, "i8")) for x in (pa_, ps, n)], pa.array(lo.astype("i4")), pa.array(hi.astype("i4"))],
                    ["a", "s", "pa", "ps", "n", "lo", "hi"],
                )

    return run


# --- the operator ---------------------------------------------------------------------------------------------


def texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct texts ``k1``, ``k2``, ``text``."""
    k1, k2 = text_key(F.col(text_col))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor those whose anchor has another row beside them.

    The first and the last row of a partition stay too, as their anchors may go on in another one.
    """
    before, held = None, None  # the anchor before the held row, which waits for the one after it
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        a = whole.column(0).to_numpy()
        same = a[1:] == a[:-1]
        keep = np.append(same, False) | np.concatenate([[before is None or before == a[0]], same])
        last = len(a) - 1
        keep[last] = False
        yield from whole.filter(pa.array(keep)).to_batches()
        held, before = whole.slice(last), (a[last - 1] if last else before)
    if held is not None:
        yield from held.to_batches()


def known_snippets(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """Snippets of all rows that may share their anchor.

    Rows are put in ranges of anchors without a pass over all of them for the bounds: quantiles of a few rows do.
    """
    k1, k2 = text_key(F.col(text_col))
    salt = F.pmod(F.xxhash64(F.lit("salt"), F.col(id_col).cast("string")), F.lit(1 << 40))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), salt.alias("salt"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = [i / parts for i in range(1, parts)]
    schema = SNIPPET + ", part int"
    bounds = None
    if shares:
        # by row, not by text, so that copies weigh as they do in the whole
        few = rows.filter(F.pmod("salt", F.lit(LOOK_AT)) == 0).mapInArrow(_snippets(length, []), schema)
        bounds = few.agg(F.percentile_approx("a", shares)).first()[0]
    bounds = bounds or [int((x - 0.5) * 2**64) for x in shares]
    dealt = rows.mapInArrow(_snippets(length, bounds), schema).repartitionById(parts, F.col("part")).drop("part")
    return store(dealt.sortWithinPartitions("a").mapInArrow(_shared, SNIPPET))


def distinct_snippets(rows: DataFrame, count, place: list[str], length: int, most: int) -> DataFrame:
    """A row for each snippet (``a``, ``s``) of an anchor with more than one: ``n``, where one stands, and whether its anchor is crowded.

    Counts are summed before they are shuffled.
    """
    by_snippet = rows.groupBy("a", "s").agg(count.alias("n"), F.min(F.struct(*place, "lo", "hi")).alias("x"))
    size = F.sum(F.col("x.hi") - F.col("x.lo") + length)
    by_anchor = by_snippet.groupBy("a").agg(F.sum("n").alias("all"), (size > most).alias("crowded")).filter("all > 1").drop("all")
    return by_snippet.join(by_anchor, "a").select("a", "s", "n", "x.*", "crowded")


def solve(pieces: DataFrame, length: int, most: int, longer: tuple[int, ...]) -> DataFrame:
    """Marked window starts ``lo`` to ``hi`` in each piece (``a``, ``s``, ``n``, ``snippet``, ``crowded``)."""
    spark = pieces.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cool = pieces.filter("NOT crowded").drop("crowded")
    out = cool.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_index(length), MARKS)
    crowded = pieces.filter("crowded").drop("crowded")
    if not longer or crowded.isEmpty():
        return out
    rows = store(crowded.repartition(parts, "a", "s").mapInArrow(_deal(length, longer[0]), "a long, s long, pa long, ps long, n long, lo int, hi int"))
    own = distinct_snippets(rows, F.sum("n"), ["pa", "ps"], length, most if longer[1:] else 2**62)
    whole = crowded.select(F.col("a").alias("pa"), F.col("s").alias("ps"), "snippet")
    part = F.expr(f"substring(snippet, lo + 1, hi - lo + {length})")
    found = solve(cut(own.join(whole, ["pa", "ps"]).select("a", "s", "n", part.alias("snippet"), "crowded")), length, most, longer[1:])
    back = rows.select("a", "s", "pa", "ps", F.col("lo").alias("at")).join(found, ["a", "s"])
    return out.unionByName(back.select(F.col("pa").alias("a"), F.col("ps").alias("s"), (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi")))


def repeated(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, most: int = CROWDED_BYTES) -> DataFrame:
    """Marked window starts ``lo`` to ``hi`` of each text (``k1``, ``k2``)."""
    known = known_snippets(docs, id_col, text_col, length)
    own = distinct_snippets(known, F.count(F.lit(1)), ["k1", "k2"], length, most)
    todo = own.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "s", "n", "lo", "hi", "crowded")).alias("todo"))
    pieces = texts(docs, text_col).join(todo, ["k1", "k2"]).select("text", "todo").mapInArrow(_cut_out(length), PIECE + ", crowded boolean")
    found = cut(solve(store(pieces), length, most, tuple(g if g < length else length for g in LONGER)))
    back = known.select("a", "s", "k1", "k2", F.col("lo").alias("at")).join(found, ["a", "s"])
    return back.select("k1", "k2", (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi"))


def spans(marks: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs ``[start, stop)``."""
    out: list[list[int]] = []
    for lo, hi in sorted((m["lo"], m["hi"] + length) for m in marks):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, crowded_bytes: int = CROWDED_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (remaining bytes) of each row.

    Null texts count as empty; texts shorter than ``length`` lose nothing; equal rows (of one id or more) repeat
    each other and lose all; null ids pass; an empty table gives an empty result; other columns are not read.
    """
    distinct = texts(docs, text_col)
    marks = repeated(docs, id_col, text_col, length, crowded_bytes).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone = spans(own or [], length)
                ends = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((k1, k2, len(raw), len(raw) - len(kept), [{"start": a, "stop": b} for a, b in gone], hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, _RESULT, strict=True)], ["k1", "k2", "n_bytes", "n_removed", "spans", "kept_sha256"]
            )

    schema = "k1 long, k2 long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"
    done = distinct.join(marks, ["k1", "k2"], "left").select("k1", "k2", "text", "marks").mapInArrow(run, schema)
    k1, k2 = text_key(F.col(text_col))
    ids = docs.select(F.col(id_col).alias(id_col), k1.alias("k1"), k2.alias("k2"))
    return ids.join(done, ["k1", "k2"]).drop("k1", "k2")


_RESULT = ("int64", "int64", "int64", "int64", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of :func:`remove_repeats` of ``documents``; nulls, ties, repeated rows and empty tables as told there."""
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
