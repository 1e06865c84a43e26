"""Benchmark decontamination by pigeonhole edit matching.

With ``k`` errors allowed, an item is split into ``k + 1`` pieces, one of which a match must hold unchanged.  Texts are
scanned once, whatever the benchmark's size: rolling hashes are looked up in bitmaps of bounded size, hits meet their
pieces in a join, and what stands around a hit is verified by Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, read, store, text_key

#: Errors allowed for each character of an item.
RATE = 0.06
#: Characters that are looked up first; pieces may be shorter.
GRAM = 8
#: Bits of a bitmap for each piece, and the least and greatest power of two that a bitmap has.
BITS_A_PIECE, LEAST_POWER, MOST_POWER = 64, 16, 27
#: Characters of a text that are hashed at once.
BLOCK = 1 << 20
_GAP = re.compile(r"[\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def normalise(text: str | None) -> str:
    """Words in lower case, one space before, between and after them: a match begins and ends at words, or pays for it."""
    own = _GAP.sub(" ", (text or "").lower()).strip()
    return f" {own} " if own else ""


def errors_allowed(item: str, rate: float) -> int:
    return int((len(item) - 2) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their places."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(item_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and where the first such part ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d = full, 0, m
    best, end = m, 0
    get = item_masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
        if d < best:
            best, end = d, at
    return best, end


class Rolling:
    """Hashes of all parts of one length of a text: differences of running sums of powers, in words of 64 bits."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        codes = (codes + np.uint64(1)) * _MIX
        codes ^= codes >> np.uint64(32)
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, "u8")
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def at(self, places: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` characters from ``places`` on."""
        h = (self.sums[places + n] - self.sums[places]) * self.down[places]
        h = (h ^ h >> np.uint64(29)) * _MIX
        return h ^ h >> np.uint64(32)

    def all(self, n: int) -> np.ndarray:
        m = max(len(self.sums) - n, 0)
        h = (self.sums[n:] - self.sums[:m]) * self.down[:m]
        h = (h ^ h >> np.uint64(29)) * _MIX
        return h ^ h >> np.uint64(32)


_POWERS: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for i, b in enumerate((_B, _B_INVERSE)):
            own = np.full(size, b, "u8")
            own[0] = 1
            _POWERS[i] = np.cumprod(own)
    return _POWERS[0], _POWERS[1]


def _in(bitmap: np.ndarray, power: int, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - power)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype("u1")) & 1 > 0


class Filter:
    """What a task knows of all pieces: bitmaps of their first characters and of all of them, and which lengths there are."""

    def __init__(self, grams: np.ndarray, whole: np.ndarray, power: int, lengths: dict[int, list[int]]):
        self.grams, self.whole, self.power = grams, whole, power
        self.lengths = lengths  # characters looked up first -> lengths of pieces

    def hits(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes of parts that may be pieces."""
        longest = max((max(x) for x in self.lengths.values()), default=0)
        for at in range(0, len(text), BLOCK):
            rolling = Rolling(text[at : at + BLOCK + longest - 1])
            for gram, lengths in self.lengths.items():
                some = np.flatnonzero(_in(self.grams, self.power, rolling.all(gram)[:BLOCK]))
                for n in lengths:
                    here = some[some + n < len(rolling.sums)]
                    h = rolling.at(here, n)
                    good = _in(self.whole, self.power, h)
                    if good.any():
                        yield here[good] + at, h[good].view("i8")


PIECES = "item_id long, item long, k int, size int, at int, n int, gram long, h long"


def _split(rate: float):
    """Pieces of items: hash of their first characters, hash of all, length, and place in the item, which a hash names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = normalise(text)
                if not item:
                    continue
                k, rolling = errors_allowed(item, rate), Rolling(item)
                hashed = lambda at, n, rolling=rolling: int(rolling.at(np.array([at]), n).view("i8")[0])
                for at, piece in pieces(item, k):
                    n = len(piece)
                    row = (key, hashed(0, len(item)), k, len(item), at, n, hashed(at, min(n, GRAM)), hashed(at, n))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            types = ("int64", "int64", "int32", "int32", "int32", "int32", "int64", "int64")
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items by id and hash, with their normalised text."""
    for batch in batches:
        texts = [normalise(t) for t in batch.column(1).to_pylist()]
        hashes = [int(Rolling(t).at(np.array([0]), len(t)).view("i8")[0]) if t else None for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, "int64"), pa.array(texts, "string")], ["item_id", "item", "item_text"])


def _bitmap(pieces_: DataFrame, column: str, power: int) -> np.ndarray:
    """Bits of the slots that hashes fall into: segments are built in tasks, ``2^power`` bits in all reach the driver."""
    segment = max(power - 10, 3)

    def build(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << segment, bool)
        bits[table["low"].to_numpy()] = True
        return pa.table({"high": table["high"][:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slot = F.shiftrightunsigned(column, 64 - power)
    rows = pieces_.select(F.shiftright(slot, segment).alias("high"), slot.bitwiseAND((1 << segment) - 1).alias("low")).distinct()
    out = np.zeros((1 << power) // 8, "u1")
    for r in rows.groupBy("high").applyInArrow(build, "high long, bits binary").toArrow().to_pylist():
        own = np.frombuffer(r["bits"], "u1")
        out[r["high"] * len(own) : (r["high"] + 1) * len(own)] = own
    return out


def _filter(pieces_: DataFrame) -> Filter:
    n = pieces_.count()
    power = min(max((n * BITS_A_PIECE).bit_length(), LEAST_POWER), MOST_POWER)
    lengths: dict[int, list[int]] = {}
    for r in pieces_.select("n").distinct().orderBy("n").collect():  # as many as pieces have lengths
        lengths.setdefault(min(r["n"], GRAM), []).append(r["n"])
    return Filter(_bitmap(pieces_, "gram", power), _bitmap(pieces_, "h", power), power, lengths)


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes = [], [], []
            for i, t in enumerate(batch.column(0)):
                for at, h in sent.value.hits(normalise(t.as_py())):
                    rows.append(np.full(len(at), i))
                    places.append(at)
                    hashes.append(h)
            if rows:
                own = batch.select([1, 2]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], ["k1", "k2", "h", "pos"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts and the starts of an item that hits tell (``item_id``, ``k``, ``size``, ``start``): the parts to verify."""
    names = ["k1", "k2", "item_id", "item", "begin", "window"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for text, k1, k2, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = normalise(text)
            lo = None
            found.sort(key=lambda x: (x["item_id"], x["item"], x["start"]))
            for x, nxt in zip(found, [*found[1:], None], strict=True):
                # hits whose windows overlap are verified together
                lo = x["start"] if lo is None else lo
                if nxt is None or (nxt["item_id"], nxt["item"]) != (x["item_id"], x["item"]) or nxt["start"] - x["start"] > 2 * x["k"] + x["size"]:
                    begin = max(0, lo - x["k"])
                    window = own[begin : max(0, x["start"] + x["size"] + x["k"])]
                    for column, v in zip(out, (k1, k2, x["item_id"], x["item"], begin, window), strict=True):
                        column.append(v)
                    lo = None
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*["int64"] * 5, "string"), strict=True)], names)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, bits = None, {}
    for batch in batches:
        keep, distances, ends = [], [], []
        for i, (begin, window, item, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 7)), strict=True)):
            if item != last:
                last, bits = item, masks(item)
            d, end = myers(bits, len(item), window)
            if d <= k:
                keep.append(i)
                distances.append(d)
                ends.append(begin + end)
        own = batch.select([0, 1, 2]).take(pa.array(keep, "int64"))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(distances, "int32"), pa.array(ends, "int64")], ["k1", "k2", "item_id", "distance", "match_end"])


def _found(rows: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """``k1``, ``k2`` (the hashes that name a text), ``item_id``, ``distance`` and ``match_end`` of what ``rows`` hold.

    ``rows`` has ``text``, ``k1`` and ``k2``.  Every table but the texts is of items or hits; joins send the smaller side if
    its size, which is known as it is written, is under the session's threshold.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    pieces_ = store(items.mapInArrow(_split(rate), PIECES))
    sent = rows.sparkSession.sparkContext.broadcast(_filter(pieces_))  # of bounded size
    hits = rows.select("text", "k1", "k2").mapInArrow(_scan(sent), "k1 long, k2 long, h long, pos long")
    told = F.struct("item_id", "item", "k", "size", (F.col("pos") - F.col("at")).alias("start"))
    starts = hits.join(pieces_, "h").groupBy("k1", "k2").agg(F.collect_set(told).alias("found"))
    own = rows.join(store(starts), ["k1", "k2"]).select("text", "k1", "k2", "found")
    windows = own.mapInArrow(_windows, "k1 long, k2 long, item_id long, item long, begin long, window string").dropDuplicates(["k1", "k2", "item_id", "item", "begin"])
    texts = store(items.mapInArrow(_named, "item_id long, item long, item_text string"))
    judged = windows.join(texts.join(pieces_.select("item_id", "item", "k").distinct(), ["item_id", "item"]), ["item_id", "item"])
    good = judged.select("k1", "k2", "item_id", "begin", "window", "item_text", "k").mapInArrow(_verify, "k1 long, k2 long, item_id long, distance int, match_end long")
    return store(good.groupBy("k1", "k2", "item_id").agg(F.min(F.struct("distance", "match_end")).alias("b")).select("k1", "k2", "item_id", "b.*"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` and ``match_end`` for each document and item that it holds.

    ``benchmark`` has ``item_id`` and ``text``.  Both sides are lower-cased words with single spaces around them, so an item of
    any length matches at words, with one error for each 1 / ``rate`` characters; ``match_end`` counts in that form.
    Null, empty and punctuation-only texts match nothing on either side; repeated documents match alike, repeated items
    once; null ids pass; empty tables give an empty result; other columns are not read.
    """
    names = dict(zip(("k1", "k2"), text_key(F.col(text_col)), strict=True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[k.alias(n) for n, k in names.items()])
    found = _found(rows, benchmark, rate)
    return rows.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "item_id", "distance", "match_end")


def clean(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item (see :func:`leaks`), all columns as they were, whatever their names."""
    k1, k2 = free(docs, "key1", "key2").values()
    one, two = text_key(F.col(text_col))
    found = _found(docs.select(F.col(text_col).alias("text"), one.alias("k1"), two.alias("k2")), benchmark, rate)
    leaky = store(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
    return docs.withColumns({k1: one, k2: two}).join(leaky, [k1, k2], "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`leaks` of ``documents`` and ``benchmark``; nulls, ties, long texts, repeated rows and empty tables as told there."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {}
