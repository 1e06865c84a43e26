"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Fingerprints within three bits of each other share a variant: one of them flips up to two bits, the other up to
one.  Every distinct fingerprint emits the variants within one bit.  Two bits are flipped by fingerprints of odd
parity alone (at distance three the parities differ), and only within a half of the word (of three bits, two lie
in one half).  Rows are shuffled on the variant; in each group everyone is linked to the smallest fingerprint that
came there by one bit at most, which is within three bits of all of them, and joins all that the group proves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, read, store, swept, text_key

SEED = 42
RADIUS = 3
WIDTH = 3
#: Tables of links are written in files of so many rows (16 bytes each), in so many files at least.
LINKS_A_FILE, LEAST_FILES = 500_000, 8
#: Texts that share one of these bands of minima are compared: of pairs at similarity 0.8, by the formula, 7 in 100,000 share none.
BANDS, ROWS = 24, 5
#: Minima that are taken for sketches; the bands are over the first of them.
MINIMA = 120
#: Texts are compared if so many minima agree in two bits: at 0.8, by the formula, 1 in 100,000 pairs has fewer.
AGREE = 84
#: Rows of a band from which on it may be split over several tasks; rows of all bands that one task can have.
LEAST_BAND, WHOLE = 500, 50_000
#: The class of linked fingerprints and four bands: by them followers of the very first texts are found before all others meet.
EARLY = 1 + 4
#: Bytes of a sketch: two bits for each minimum, in whole words; then the class and 32 bits of each band, which tell where two texts meet first.
BITS = 32
SKETCH = BITS + 8 + 4 * BANDS
_LOW = np.uint64(0x5555555555555555)
_XORS = np.random.default_rng(SEED).integers(0, 1 << 63, MINIMA, "u8") * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, MINIMA, "u8") * np.uint64(2) + np.uint64(1)
_ONE = [1 << i for i in range(64)]
SINGLES = np.array([0, *_ONE], "u8")
PAIRS = np.array([a | b for h in (0, 32) for i, a in enumerate(_ONE[h : h + 32]) for b in _ONE[h + i + 1 : h + 32]], "u8")
MASKS = np.concatenate([SINGLES, PAIRS])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """``bytes.lower`` and ``bytes.split`` know ASCII alone, as the words are defined."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws])
    n = max(1, len(ws) - width + 1)
    stops = (ends[min(width, len(ws)) - 1 :] - 1).tolist()
    starts = [0, *ends.tolist()][:n]
    digest = xxhash.xxh64_intdigest
    hs = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    total = np.zeros(64, "i8")
    for i in range(0, n, 4096):
        total += np.unpackbits(hs[i : i + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(
    docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ()
) -> DataFrame:
    """``doc`` and ``fp`` (64 bits as a signed long) of each row; null and wordless texts have fingerprint 0.

    ``keys`` names two further columns for the 128 bits that name the text.
    """
    names = ["doc", "fp", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, "int64"), *batch.columns[2:]], names)

    text = F.col(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), *[k.alias(n) for n, k in zip(keys, text_key(text))])
    return own.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view("u8")
        odd = np.unpackbits(fps.view("u1").reshape(-1, 8), axis=1).sum(axis=1) % 2 == 1
        for some, masks, at in ((fps, SINGLES, 0), (fps[odd], PAIRS, len(SINGLES))):
            for i in range(0, len(some), 64):
                own = some[i : i + 64]
                m = np.tile(np.arange(at, at + len(masks), dtype="i2"), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(masks)).view("i8")), pa.array(m)], ["fp", "m"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by ``z``: batches are joined where a group goes on, groups have some 1,000 members at most."""
    rest_z, rest_f, rest_s = np.empty(0, "i8"), np.empty(0, "u8"), np.empty(0, bool)

    def links(z, f, single):
        new = np.ones(len(z), bool)
        new[1:] = z[1:] != z[:-1]
        starts = np.flatnonzero(new)
        hubs = np.minimum.reduceat(np.where(single, f, np.iinfo("u8").max), starts)
        some = np.logical_or.reduceat(single, starts)
        group = np.cumsum(new) - 1
        hub = hubs[group]
        d = np.unpackbits((f ^ hub).view("u1").reshape(-1, 8), axis=1).sum(axis=1)
        good = some[group] & (f != hub) & (d <= RADIUS)  # verified, though the variants prove it
        pair = np.unique(np.stack([f[good], hub[good]]).view("i8"), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    for batch in batches:
        z = np.concatenate([rest_z, batch.column(0).to_numpy(zero_copy_only=False)])
        m = batch.column(1).to_numpy(zero_copy_only=False)
        f = np.concatenate([rest_f, batch.column(0).to_numpy(zero_copy_only=False).view("u8") ^ MASKS[m]])
        s = np.concatenate([rest_s, m < len(SINGLES)])
        if not len(z):
            continue
        k = np.searchsorted(z, z[-1])
        rest_z, rest_f, rest_s = z[k:], f[k:], s[k:]
        if k:
            yield links(z[:k], f[:k], s[:k])
    if len(rest_z):
        yield links(rest_z, rest_f, rest_s)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Verified links ``a``, ``b`` between distinct fingerprints (column ``fp``) that join all within the radius."""
    # The fingerprint travels with the number of its variant: neighbours in the shuffle are alike and compress.
    masks = F.array(*[F.lit(_signed(int(x))) for x in MASKS])
    z = F.col("fp").bitwiseXOR(F.get(masks, F.col("m").cast("int")))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # Fingerprints are few bytes, and each becomes hundreds of rows: a number of partitions is named, which is not coalesced.
    variants = fps.select("fp").repartition(parts, "fp").distinct().mapInArrow(_emit, "fp long, m short")
    met = variants.repartition(parts, z).select(z.alias("z"), "m").sortWithinPartitions("z").mapInArrow(_meet, "a long, b long")
    return met.distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has a link.

    Alternates large-star and small-star steps: every round is two aggregations and joins over the links; the
    number of rounds grows with the logarithm of the longest chain.  Links never become more, so every round writes
    as many files as the first links need, not one for each shuffle partition.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    parts = max(LEAST_FILES, -(-edges.count() // LINKS_A_FILE))
    seen = None
    while True:  # the roots only ever get smaller, so the state comes to stay
        # large-star: larger neighbours go to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large.coalesce(parts))
        # small-star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def classes(fps: DataFrame) -> DataFrame:
    """``fp`` and ``component_id`` (smallest ``doc`` reachable) of each fingerprint in ``fps`` (``doc``, ``fp``)."""
    least = cut(fps.groupBy("fp").agg(F.min("doc").alias("least")))
    root = components(link_fingerprints(least))
    # Fingerprints without links name themselves; only linked ones are grouped.
    nodes = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    linked = nodes.join(least, nodes["node"] == least["fp"]).select("node", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("id"))
    named = linked.join(ids, "root").select(F.col("node").alias("fp"), "id")
    # Written, so that a join with many rows of one fingerprint reads two shuffles, which can be split where they are skewed.
    return cut(least.join(named, "fp", "left").select("fp", F.coalesce("id", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id linked to the row.

    Null ids keep their class but never name it; repeated rows are in one class; null, empty and wordless texts
    have fingerprint zero and are linked like others; an empty table gives an empty result; other columns are
    not read.
    """
    fps = cut(fingerprints(docs, width=width, id_col=id_col, text_col=text_col))
    return fps.join(classes(fps), "fp").select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def bands(text: str | None, width: int) -> tuple[np.ndarray, bytes]:
    """``BANDS`` hashes of ``ROWS`` minima each over the hashed shingles, and their sketch, still without a class.

    Two texts share a hash with probability 1 - (1 - J^ROWS)^BANDS.
    """
    hs = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, width)], "u8")
    least = np.full(MINIMA, np.iinfo("u8").max, "u8")
    for i in range(0, len(hs), 1024):
        least = np.minimum(least, ((hs[i : i + 1024, None] ^ _XORS) * _FACTORS).min(axis=0))
    hashes = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))]
    bits = np.zeros(4 * BITS, "u1")
    bits[: len(least)] = (least >> np.uint64(24)).astype("u1") & 3
    packed = bits[0::4] | bits[1::4] << 2 | bits[2::4] << 4 | bits[3::4] << 6
    hashes = np.array(hashes, "u8")
    return hashes, packed.tobytes() + hashes.astype("<u4").tobytes()


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the class (``h``) before the bands (``hs``), and in the sketch before theirs."""
    for batch in batches:
        hs = [[h, *bs] for h, bs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        own = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        sketches = [s[:BITS] + h.tobytes() + s[BITS:] for h, s in zip(own, batch.column(2).to_pylist(), strict=True)]
        cols = [pa.array(hs, pa.list_(pa.int64())), pa.array(sketches, "binary"), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(cols, ["hs", "sketch", *batch.schema.names[3:]])


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of words) agree in too few minima for a similarity of 0.8."""
    x = (a[: BITS // 8] ^ b[: BITS // 8]).view("u8")
    return np.bitwise_count((x | x >> np.uint64(1)) & _LOW).sum(axis=0) > MINIMA - AGREE


def elsewhere(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches that meet in the bands ``h`` meet in an earlier band as well, where their pair is given."""
    x, y = (np.ascontiguousarray(s[BITS // 8 :].T).view("<u4") for s in (a, b))
    if not len(x):
        return np.zeros(0, bool)
    first = (x == y).argmax(axis=1)
    return x[np.arange(len(x)), first] != (h & 0xFFFFFFFF).astype("u4")


def _star(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``h``, ``salt``, ``f``, ``k1``, ``k2``, ``sketch``, ``copy``, sorted: each of a shared ``h`` with each of the first ``k`` before it.

    Of a band that is split over salts, every salt has copies of the first ``k``, which are compared with but not given
    themselves.  ``j`` numbers the first ones (``a1``, ``a2``); ``late`` rows come after the first ``k``.  Only pairs
    whose sketches may be near are given, and in the first band that they share alone.  Each row has one of ``j`` 0, with its sketch and with nulls where there is no pair.
    """

    def links(own: np.ndarray, todo: np.ndarray, rank: np.ndarray, heads: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        for j in range(k):
            some = np.flatnonzero(todo & (rank > j) if j else todo)
            if not len(some):
                break
            head = heads[np.minimum(first[some] + j, len(heads) - 1)]
            none = (rank[some] == 0) | unlike(own[6:, some], own[6:, head])
            near = np.flatnonzero(~none)
            none[near] = elsewhere(own[0, some[near]], own[6:, some[near]], own[6:, head[near]])
            if j:
                some, head, none = some[~none], head[~none], none[~none]
            cols = [own[0, some], *own[2:5, some], *[pa.array(x, mask=none) for x in own[3:5, head]], rank[some] >= k, np.full(len(some), j, "i4")]
            raw = np.ascontiguousarray(own[6:, some].T).tobytes()
            sketch = pa.nulls(len(some), "binary") if j else pa.array([raw[i : i + SKETCH] for i in range(0, len(raw), SKETCH)], "binary")
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], sketch], ["h", "f", "k1", "k2", "a1", "a2", "late", "j", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the group that goes on, its first rows alone are held; one that is single so far was not given yet.
        held, given = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([c.cast("int64").to_numpy(zero_copy_only=False) for c in batch.columns[:6]])
            own = np.concatenate([own, np.frombuffer(b"".join(batch.column(6).to_pylist()), "i8").reshape(batch.num_rows, -1).T])
            own = own if held is None else np.concatenate([held, own], axis=1)
            opens, differs = np.ones(own.shape[1], bool), np.ones(own.shape[1], bool)
            opens[1:] = (own[:2, 1:] != own[:2, :-1]).any(axis=0)
            differs[1:] = opens[1:] | (own[2:5, 1:] != own[2:5, :-1]).any(axis=0)  # else the row that a copy stands for
            group = np.cumsum(opens) - 1
            place = np.cumsum(differs) - 1
            heads = np.flatnonzero(differs)
            first = place[np.flatnonzero(opens)]  # by group
            size = np.diff(np.append(first, len(heads)))
            shared = (size > 1) | (np.bincount(group, own[5]) > 0)
            todo = shared[group] & (own[5] == 0)
            todo[:given] = False
            yield from links(own, todo, place - first[group], heads, first[group])
            held = own[:, heads[first[-1] : first[-1] + k]]
            given = held.shape[1] if shared[-1] else 0

    return run


def _dealt(left: DataFrame, k: int, parts: int) -> DataFrame:
    """Rows of bands with a ``salt``: bands of many rows are split, and each salt gets copies of the band's first ``k`` rows."""
    cols = ["h", "salt", "f", "k1", "k2", "copy", "sketch"]
    rows = left.withColumns({"salt": F.lit(0), "copy": F.lit(0)}).select(*cols)
    n = left.count()
    if n > WHOLE:  # else one task can have them all
        limit = max(LEAST_BAND, n // (8 * parts))
        sizes = left.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
        hot = store(sizes.select("h", F.ceil(F.col("n") / limit).cast("int").alias("salts")))  # of known size: sent if small
        if not hot.isEmpty():
            salt = F.coalesce(F.pmod("k1", F.col("salts").cast("long")), F.lit(0)).cast("int")
            rows = left.join(hot, "h", "left").withColumns({"salt": salt, "copy": F.lit(0)}).select(*cols)
            order = Window.partitionBy("h").orderBy("f", "k1", "k2")
            heads = left.join(hot, "h").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)  # each task keeps k rows of a band
            heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("copy", F.lit(1))
            rows = rows.unionByName(heads.select(*cols))
    return rows.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "f", "k1", "k2", F.desc("copy"))


def _meeting(texts: DataFrame) -> DataFrame:
    """``texts`` that share a band with others, and of their bands (``hs``, ``early``: of the first ``EARLY``) those that they share.

    Most bands have one text alone, which needs no sketch to be told: bands travel without them, by half of the text's key.
    Texts that have this half in common are told apart by their own bands.
    """
    every = texts.select(F.explode("hs").alias("h"), "k1")
    several = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    shared = every.join(several, "h", "left_semi").groupBy("k1").agg(F.collect_list("h").alias("shared"))
    early = F.array_intersect(F.slice("hs", 1, EARLY), "shared").alias("early")
    here = texts.join(shared, "k1").select(F.array_intersect("hs", "shared").alias("hs"), early, "sketch", "_first", "k1", "k2")
    return cut(here)


def _staying(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """``k1``, ``k2`` and ``_first`` (least ``doc``) of the texts that stay, of rows ``_text``, ``doc``, ``k1``, ``k2``."""
    own = ["k1", "k2"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [bands(t.as_py(), width) for t in batch.column(0)]
            hs, sketches = pa.array([h.view("i8") for h, _ in both], pa.list_(pa.int64())), pa.array([x for _, x in both], "binary")
            fps = pa.array([_signed(fingerprint(t.as_py())) for t in batch.column(0)], "int64")
            yield pa.RecordBatch.from_arrays([hs, sketches, fps, *batch.columns[1:]], ["hs", "sketch", "fp", "doc", *own])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [jaccard(a.as_py(), b.as_py(), width) >= similarity for a, b in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, "bool"))

    # Texts stay where they are: their keys and bands alone are grouped.
    texts = rows.mapInArrow(banded, "hs array<long>, sketch binary, fp long, doc long, k1 long, k2 long")
    texts = cut(texts.groupBy(*own).agg(F.min("doc").alias("_first"), *[F.first(c).alias(c) for c in ("hs", "sketch", "fp")]))
    # A class is named by its least fingerprint, as rows without id have no other name.
    linked = classes(texts.select(F.col("fp").alias("doc"), "fp"))
    named = texts.join(linked, "fp").select(F.xxhash64(F.lit("class"), "component_id").alias("h"), "hs", "sketch", "_first", *own)
    texts = cut(named.mapInArrow(_classed, "hs array<long>, sketch binary, _first long, k1 long, k2 long"))
    meeting = _meeting(texts)
    left = meeting.select(F.explode("hs").alias("h"), F.col("_first").alias("f"), *own, "sketch")
    bodies, gone = None, None

    def closest(met: DataFrame) -> DataFrame:
        """The pairs of ``met`` that are near by their shingles."""
        nonlocal bodies
        pairs = met.filter("a1 IS NOT NULL").select(*own, "a1", "a2").distinct()
        if bodies is None:
            # Only texts that meet others travel, one of each: its first row, so that copies of a text go to many tasks.
            wanted = cut(met.select(F.col("f").alias("doc"), *own).distinct())
            here = cut(rows.join(wanted, [*own, "doc"]).dropDuplicates([*own, "doc"]).select(*own, "_text"))
        else:
            here = bodies
        bodies = here if met is not early else None
        heads = here.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("_text").alias("_head_text"))
        pairs = pairs.join(here, own).join(heads, ["a1", "a2"]).select(*own, "a1", "a2", "_text", "_head_text")
        return cut(pairs.mapInArrow(near, "k1 long, k2 long, a1 long, a2 long"))

    # A text that is the first in all of its bands stays, whatever else there is.  In a large group of copies that is its
    # first one, and a few bands are enough to find most of the others, which then need no further look.
    met_schema = "h long, f long, k1 long, k2 long, a1 long, a2 long, late boolean, j int, sketch binary"
    some = meeting.select(F.explode("early").alias("h"), F.col("_first").alias("f"), *own, "sketch")
    early = cut(_dealt(some, 1, parts).mapInArrow(_star(1), met_schema))
    close = closest(early)
    heads = close.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).distinct()
    theirs = meeting.join(heads, own, "left_semi").select(F.explode("hs").alias("h"), *own)
    leaders = left.groupBy("h").agg(F.min(F.struct("f", *own)).alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = theirs.join(leaders, "h").filter((F.col("leader.k1") != F.col("k1")) | (F.col("leader.k2") != F.col("k2")))
    sure = heads.join(late, own, "left_anti").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    gone = cut(close.join(sure, ["a1", "a2"], "left_semi").select(*own).distinct())
    left = left.join(gone, own, "left_anti")
    k = 1
    while True:
        met = cut(_dealt(left, k, parts).mapInArrow(_star(k), met_schema))
        if met.isEmpty():
            break
        close = closest(met)
        stay = met.groupBy(*own).agg(F.max("late").alias("late")).filter("NOT late").join(close, own, "left_anti")
        stay = cut(stay.select(F.col("k1").alias("a1"), F.col("k2").alias("a2")))
        go = cut(close.join(stay, ["a1", "a2"], "left_semi").select(*own).distinct())
        settled = go.unionByName(stay.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")))
        left = met.filter("j = 0").join(settled, own, "left_anti").select("h", "f", *own, "sketch")
        gone = gone.unionByName(go)
        k *= 16
    return cut(texts.select("_first", *own).join(gone, own, "left_anti"))


def one_of_each(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies of rows that stay, columns as they were.

    In order of their ids, a text stays unless its set of word shingles has a Jaccard similarity of ``similarity`` or
    more with one that stays before it.  Texts whose SimHash fingerprints are linked (:func:`classes`) are compared by
    their shingles, and then those that share a band of minima, which finds copies beyond the radius.  Of rows that share
    an id and near-equal texts one stays; rows without id come last.  Null counts as an empty text.

    A class of linked fingerprints is the first band of its texts.  First, what is near a text that is the first in all
    of its bands goes, as the class and a few bands tell.  Then each round compares
    the texts of a band with its first ones; a band of many texts is split over tasks, and its first texts are sent to each.  A text that is among the first in all of its bands
    and near none before it stays, and those near it go; the others meet again, with more first ones.
    """
    names, own = docs.columns, ["k1", "k2"]
    first, *key = free(docs, "first", "key1", "key2").values()
    last = F.lit(2**63 - 1)  # rows without id come last
    tagged = docs.withColumns(dict(zip(key, text_key(F.col(text_col)))) | {first: F.coalesce(F.col(id_col).cast("long"), last)})
    rows = tagged.select(F.col(text_col).alias("_text"), F.col(first).alias("doc"), *[F.col(k).alias(o) for k, o in zip(key, own)])
    with swept(docs.sparkSession):
        texts = _staying(rows, width, similarity)
    texts = texts.select(F.col("_first").alias(first), *[F.col(o).alias(n) for n, o in zip(key, own)])
    kept = tagged.join(texts, [*key, first])
    # Equal rows: one stays.
    return kept.dropDuplicates([*key, first]).select(*names)


def shingles(text: str | None, width: int) -> set[bytes]:
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))}


def jaccard(a: str | None, b: str | None, width: int) -> float:
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` of ``documents``; nulls, ties, repeated rows and empty tables as told there."""
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
