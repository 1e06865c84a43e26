"""Phrase collocations with pivot partitioning: each n-gram is mined where its rarest word is.

A first pass counts words.  Counts of frequent words become a sketch of bounded size that tells every task which
words cannot be in a frequent phrase (they break the text) and which of two words is the rarer.  A second pass
rewrites the text around each word to the neighbours that are not rarer, and routes these fragments to bins by
that word, the pivot.  A bin counts the n-grams that its pivots own, so every n-gram is counted in one bin once.
Pivots with more fragments than a bin holds are split over bins by fragment, and their counts are added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, store

#: Contract of the query: least count, most words of a phrase, rows of a language; a phrase goes if one that holds it has so many percent.
LEAST, WORDS, TOP, HELD = 30, 4, 2000, 80
#: Slots of the sketch: 4 bytes each, whatever the vocabulary's size.
SLOTS = 1 << 22
#: Fragments of a bin on average at most, bins a shuffle partition, bins of a partition at most.
BIN, BINS_A_PARTITION, MOST_BINS = 250_000, 4, 16
#: Bytes of text that are held as words at once (more only for a piece that is longer), and words that a task counts before it sends them.
CHUNK, VOCABULARY = 4 << 20, 300_000
#: Chunks of all languages together, and languages whose words are numbered, that a task holds.
HELD_CHUNKS, MOST_LANGS = 4, 200
UNKNOWN = "und"
#: Pieces end at these; blanks part words.  After the translation a break is a line feed and a blank a space.
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)
#: Stands for a break among the words; no word has a full stop.
BREAK = b"."
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 8, "u8") * np.uint64(2) + np.uint64(1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and tokens of texts, some megabytes at a time, cut between pieces; each text ends with a break."""
    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()

    def tokens(lang: str) -> list[bytes]:
        size.pop(lang)
        return b"\n".join(held.pop(lang)).replace(b"\n", b" . ").split(b" ")

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            data = text.as_buffer().to_pybytes().lower().translate(_TABLE)  # ``lower`` changes A-Z alone
            at = 0
            while at < len(data):
                end = data.find(b"\n", at + CHUNK) if len(data) - at > CHUNK else -1
                end = len(data) if end < 0 else end
                held.setdefault(lang, []).append(data[at:end] + b"\n")
                size[lang] += end - at + 1
                at = end + 1
                if size[lang] > CHUNK:
                    yield lang, tokens(lang)
                elif size.total() > HELD_CHUNKS * CHUNK:  # many languages
                    most = max(size, key=size.get)
                    yield most, tokens(most)
    for lang in list(held):
        yield lang, tokens(lang)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}

    def flush(lang: str) -> pa.RecordBatch:
        own = seen.pop(lang)
        own.pop(b"", None)
        own.pop(BREAK, None)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(own), "string"), pa.array(list(own), "binary").cast("string"), pa.array(list(own.values()), "int64")], ["lang", "phrase", "a"]
        )

    for lang, words in _chunks(batches):
        seen.setdefault(lang, Counter()).update(words)
        if len(seen[lang]) > VOCABULARY:
            yield flush(lang)
        while sum(map(len, seen.values())) > 3 * VOCABULARY:
            yield flush(max(seen, key=lambda x: len(seen[x])))
    for lang in list(seen):
        yield flush(lang)


def slots(lang: Column, word: Column) -> Column:
    return F.pmod(F.xxhash64(lang, word), F.lit(SLOTS)).cast("int")


class _Words:
    """Numbers for the words of one language, in one task, with what the sketch and hashes say of them."""

    def __init__(self, sketch: np.ndarray, lang: str):
        self.ids: dict[bytes, int] = {b"": 0, BREAK: 1}
        self.sketch, self.n = sketch, 2
        # Spark's xxhash64 chains columns: the hash of the language is the seed of the word's
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.f = np.zeros(1 << 12, "u4")
        self.h = np.zeros(1 << 12, "u8")
        self.text = np.empty(1 << 12, object)
        self.text[:2] = b""

    def numbers(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        for w in set(words).difference(ids):
            n = self.n
            ids[w] = n
            self.n += 1
            if n >= len(self.f):
                for name in ("f", "h", "text"):
                    old = getattr(self, name)
                    new = np.zeros(2 * len(old), old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)
            h = xxhash.xxh64_intdigest(w, self.seed)
            self.h[n], self.text[n] = h, w
            self.f[n] = self.sketch[h % SLOTS]
        return np.fromiter(map(ids.__getitem__, words), "i4", len(words))


def _fragments(w: _Words, words: list[bytes], n_bins: int, a_bin: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Fragments by bin: bin, whether its pivots are split, numbers of the words (one stream), left and right words, weights."""
    ids = w.numbers(words)
    ids = ids[ids != 0]  # blanks that meet
    reach = WORDS - 1
    ids = np.concatenate([np.ones(reach, "i4"), ids, np.ones(reach, "i4")])
    # rarer first; words that share a number of the order are told apart by place, which every task sees alike
    order = w.f[ids].astype("u8") << np.uint64(32) | (w.h[ids] >> np.uint64(32)) * (w.f[ids] > 0)
    at = np.flatnonzero(order > 0)
    own = order[at]
    left, right = np.zeros(len(at), "i1"), np.zeros(len(at), "i1")
    go_left, go_right = np.ones(len(at), bool), np.ones(len(at), bool)
    for d in range(1, reach + 1):
        go_left &= order[at - d] > own
        go_right &= order[at + d] >= own
        left += go_left
        right += go_right
    some = np.flatnonzero((left > 0) | (right > 0))
    at, left, right = at[some], left[some], right[some]
    if not len(at):
        return
    # equal fragments of the chunk are one with a weight
    window = ids[at[:, None] + np.arange(-reach, reach + 1)]
    place = np.arange(-reach, reach + 1)
    window[(place < -left[:, None]) | (place > right[:, None])] = 0
    mixed = (w.h[window] * _MIX[: 2 * reach + 1]).sum(axis=1, dtype="u8")
    mixed ^= mixed >> np.uint64(29)
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    odd = np.flatnonzero((window != window[first[inverse]]).any(axis=1))  # a hash that two fragments share
    weight = np.bincount(inverse, minlength=len(first)).astype("i8")
    np.subtract.at(weight, inverse[odd], 1)
    pick = np.concatenate([first, odd])
    weight = np.concatenate([weight, np.ones(len(odd), "i8")])
    at, left, right, mixed, window = at[pick], left[pick], right[pick], mixed[pick], window[pick]
    pivot = ids[at]
    salts = -(-w.f[pivot].astype("i8") // a_bin)
    salt = np.where(salts > 1, mixed % np.maximum(salts, 1).astype("u8"), 0).astype("u8")
    bins = ((w.h[pivot] ^ salt * _MIX[7]) * _MIX[6] >> np.uint64(20)) % np.uint64(n_bins)
    target = bins.astype("i8") * 2 + (salts > 1)
    by_bin = np.argsort(target, kind="stable")
    target = target[by_bin]
    edges = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = by_bin[a:b]
        stream = window[rows].ravel()
        yield int(target[a] >> 1), bool(target[a] & 1), stream[stream > 0], left[rows], right[rows], weight[rows]


def _route(sketch, n_bins: int, a_bin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        for lang, words in _chunks(batches):
            if sum(x.n for x in known.values()) > 4 * VOCABULARY or len(known) > MOST_LANGS:
                known.clear()
            w = known.get(lang)
            if w is None:
                w = known[lang] = _Words(sketch.value, lang)
            out: list[list] = [[] for _ in range(7)]
            for bin_, split, stream, left, right, weight in _fragments(w, words, n_bins, a_bin):
                text = b" ".join(w.text[stream].tolist())
                shape = left.astype("u1") << 4 | right.astype("u1")
                plain = weight.max(initial=1) == 1
                row = [lang, bin_, split, len(text), pa.compress(text, codec="zstd", asbytes=True), shape.tobytes(), None if plain else weight.tobytes()]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], _NAMES)

    return run


_NAMES = ["lang", "bin", "split", "size", "words", "shape", "weight"]
_TYPES = ["string", "int64", "bool", "int32", "binary", "binary", "binary"]
ROUTED = "lang string, bin long, split boolean, size int, words binary, shape binary, weight binary"


def mine(rows: list[tuple[int, bytes, bytes, bytes | None]], least: int, split: bool) -> tuple[list[bytes], list[int]]:
    """N-grams owned by the pivots of one bin and their counts: those of ``least`` or more, or all where pivots are split."""
    words = b" ".join(pa.decompress(r[1], decompressed_size=r[0], codec="zstd", asbytes=True) for r in rows).split(b" ")
    shape = np.frombuffer(b"".join(r[2] for r in rows), "u1")
    weight = np.concatenate([np.frombuffer(r[3], "i8") if r[3] is not None else np.ones(len(r[2]), "i8") for r in rows])
    left, right = (shape >> 4).astype("i8"), (shape & 15).astype("i8")
    size = left + right + 1
    pivot = np.cumsum(size) - size + left
    number: dict[bytes, int] = {}
    for x in words:
        number.setdefault(x, len(number))
    ids = np.fromiter(map(number.__getitem__, words), "i8", len(words))
    _, pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)  # a number for each two words in a row
    pairs = np.append(pairs, 0)
    texts, counts = [], []
    often = None  # by pair: whether it is frequent; a frequent n-gram has no pair of its pivot that is not
    for m in range(2, WORDS + 1):
        starts, weights = [], []
        for a in range(m):
            some = np.flatnonzero((left >= a) & (right >= m - 1 - a))
            s = pivot[some] - a
            if often is not None:
                good = (often[pairs[s + a - 1]] if a else True) & (often[pairs[s + a]] if a < m - 1 else True)
                s, some = s[good], some[good]
            starts.append(s)
            weights.append(weight[some])
        s, own = np.concatenate(starts), np.concatenate(weights)
        key = pairs[s] if m == 2 else pairs[s] << 32 | (ids[s + 2] if m == 3 else pairs[s + 2])
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, "i8")
        total = np.add.reduceat(own[by_key], first) if len(first) else np.empty(0, "i8")
        if not split:
            if m == 2:
                often = np.zeros(int(pairs.max(initial=0)) + 1, bool)
                often[key[first[total >= least]]] = True
            first, total = first[total >= least], total[total >= least]
        for i, n in zip(s[by_key[first]].tolist(), total.tolist(), strict=True):
            texts.append(b" ".join(words[i : i + m]))
            counts.append(n)
    return texts, counts


def _mine(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by language, bin and split; one bin is held at a time."""
        key, held = None, []

        def flush() -> pa.RecordBatch:
            texts, counts = mine(held, least, key[2])
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(texts), "string"), pa.array(texts, "binary").cast("string"), pa.array(counts, "int64")], ["lang", "phrase", "a"]
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if held:
                        yield flush()
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield flush()

    return run


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", a_bin: int = BIN) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``a`` of all phrases of 1 to ``WORDS`` words found ``least`` times or more; and ``lang``, ``n``, its words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    words = cut(texts.mapInArrow(_count_words, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")))
    totals = cut(words.groupBy("lang").agg(F.sum("a").alias("n")))
    often = store(words.filter(F.col("a") >= least))
    # SLOTS rows at most
    told = often.groupBy(slots(F.col("lang"), F.col("phrase")).alias("slot")).agg(F.max("a").alias("a")).toArrow()
    sketch = np.zeros(SLOTS, "u4")
    sketch[told["slot"].to_numpy()] = np.minimum(told["a"].to_numpy(), 2**32 - 1)
    sent = spark.sparkContext.broadcast(sketch)
    n = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n_bins = max(BINS_A_PARTITION * parts, -(-n // a_bin))
    parts = max(parts, -(-n_bins // MOST_BINS))
    each = max(1000, min(a_bin, -(-n // n_bins)))
    routed = texts.mapInArrow(_route(sent, n_bins, each), ROUTED)
    dealt = routed.repartition(parts, "lang", "bin").sortWithinPartitions("lang", "bin", "split")
    mined = dealt.mapInArrow(_mine(least), "lang string, phrase string, a long")
    mined = mined.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return store(often.unionByName(mined)), totals


def collocations(
    docs: DataFrame, *, least: int = LEAST, top: int | None = TOP, held: int = HELD, text_col: str = "text", lang_col: str = "lang", a_bin: int = BIN
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the ``top`` phrases (None: all) of each language.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, at spaces and tabs into words.  ``a`` counts a
    phrase of two to four words; of its cuts into a first part (``l`` times) and a rest (``r`` times) the one with the least
    score floor(2000000 a / (l + r)) counts, of equal ones the shortest first part.  A phrase inside a longer one that
    has ``held`` percent of its count or more is dropped.  Ties of score and count go by the bytes of the phrase.

    Null texts have no words, a null language is ``und`` (as rows of that name are); repeated rows count as often as they
    come; texts of any length count whole; an empty table gives an empty result; other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, least=least, text_col=text_col, lang_col=lang_col, a_bin=a_bin)
    words = F.split("phrase", " ")
    candidates = phrases.withColumn("w", words).filter(F.size("w") > 1)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    # products pass 64 bits
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = [(m, k, i) for m in range(3, WORDS + 1) for k in range(2, m) for i in range(1, m - k + 2)]
    held_in = F.filter(F.array(*[F.when(F.size("w") == m, part(F.lit(i), F.lit(k))) for m, k, i in inside]), lambda x: x.isNotNull())
    longer = candidates.filter(F.size("w") > 2).select("lang", F.explode(held_in).alias("phrase"), F.col("a").alias("b"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("b").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("b").cast("decimal(20,0)") < F.lit(held).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`collocations` of ``documents``; nulls, ties, long texts, repeated rows and empty tables as told there."""
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM q, (VALUES (1), (2), (3), (4)) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) FILTER (WHERE m = 1)::BIGINT AS n, list({'p': phrase, 'm': m, 'a': a}) FILTER (WHERE a >= 30) AS often, map(list(phrase) FILTER (WHERE a >= 30), list(a) FILTER (WHERE a >= 30)) AS f FROM f GROUP BY lang),
o AS (SELECT lang, n, f, often, unnest(often) AS c FROM t),
k AS (SELECT lang, n, f, c.p AS phrase, c.a AS a, string_split(c.p, ' ') AS w,
  list_max(list_transform(list_filter(often, lambda q: q.m > c.m AND contains(' ' || q.p || ' ', ' ' || c.p || ' ')), lambda q: q.a)) AS b FROM o WHERE c.m > 1),
s AS (SELECT lang, n, phrase, a, list_sort(list_transform(range(1, len(w)), lambda i: {'score': ((2000000::HUGEINT * a) // (f[array_to_string(w[1:i], ' ')]::HUGEINT + f[array_to_string(w[i + 1:], ' ')]))::BIGINT, 'k': i,
  'l': f[array_to_string(w[1:i], ' ')], 'r': f[array_to_string(w[i + 1:], ' ')]}))[1] AS x FROM k WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, x.l AS l, x.r AS r, n, x.score AS score FROM r WHERE rank <= 2000
"""
QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": ORACLE}
