"""Exact line dedup: range partitions of line hashes, sorted by document and position, streamed once.

The result is a compressed keep bitmap for each document that loses lines, never its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, read

MIN_CHARS = 10
SPACE = b" \t\n\x0b\x0c\r"
BATCH = 8192


def line_key(line: bytes) -> bytes:
    """``bytes.lower`` changes A-Z alone."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, marks, at = [], [], [], []
            for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for i, line in enumerate((text or "").encode().split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        marks.append(mark)
                        at.append(i)
            h = np.frombuffer(b"".join(digests), ">i8").astype("i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, "int64"), pa.array(marks, "int64"), pa.array(at, "int32")],
                ["h1", "h2", "doc", "mark", "pos"],
            )

    return run


LINES = "h1 long, h2 long, doc long, mark long, pos int"
#: kind 0: the line goes; 1: it goes unless the partition before has no smaller document; 2: a run at an edge.
STREAMED = "kind int, h1 long, h2 long, doc long, mark long, pos int"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash, document and position: a run's first document keeps the line, later ones lose it.

    A hot line spans partitions.  Rows of a partition's first run stay open (kind 1), and each edge run tells
    its first document (kind 2); who really came first follows from the few edge rows.
    """
    hash_, first, head = None, None, True  # of the run that is open
    tails: list[tuple] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        doc = batch.column(2).fill_null(np.iinfo("i8").max).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = hash_ is None or (h1[0], h2[0]) != hash_
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: the run that came in
        firsts = np.where(run >= 0, doc[starts[np.maximum(run, 0)]] if len(starts) else 0, first if first is not None else 0)
        kind = np.where(doc != firsts, 0, -1)
        if hash_ is None:
            tails.append((h1[0], h2[0], doc[0]))
            in_head = run == 0
        else:
            in_head = (run == -1) & head
        kind = np.where(in_head, 1, kind)
        if len(starts):
            head = hash_ is None and len(starts) == 1
            hash_, first = (h1[-1], h2[-1]), doc[starts[-1]]
        keep = np.flatnonzero(kind >= 0)
        if len(keep):
            taken = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep], "int32"), *taken.columns], STREAMED_NAMES)
    if hash_ is not None:
        tails.append((*hash_, first))
        a, b, d = (np.array(x, "i8") for x in zip(*tails, strict=True))
        none = pa.nulls(len(a), "int64")
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), 2, "i4")), pa.array(a), pa.array(b), pa.array(d), none, pa.nulls(len(a), "int32")], STREAMED_NAMES
        )


STREAMED_NAMES = ["kind", "h1", "h2", "doc", "mark", "pos"]


def pack(n_lines: int, dropped: np.ndarray) -> bytes:
    """A keep bitmap: the number of lines, then the bits, deflated."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return n_lines.to_bytes(8, "big") + zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes) -> np.ndarray:
    n = int.from_bytes(bitmap[:8], "big")
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[8:]), "u1"))[:n].astype(bool)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for at in batch.column(2):
            gone = np.unique(at.values.to_numpy(zero_copy_only=False))
            maps.append(pack(int(gone[-1]) + 1, gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, "binary")], ["doc", "mark", "bitmap"])


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc``, ``mark`` (hash of the text) and ``bitmap`` for each document that loses lines.

    Rows that share an id are one document; rows without id are one document that comes last (as an id of 2^63-1 would).  A bitmap ends at
    the last dropped line; what follows stays.  Null and empty texts have one empty line, which always stays.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), mark(text_col).alias("mark"), F.col(text_col).alias("text")
    ).mapInArrow(_lines(min_chars), LINES)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["h1", "h2", "doc", "mark", "pos"]
    # A line of many documents spreads over as many partitions as it needs: the document is part of the range.
    streamed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream, STREAMED))
    edges = streamed.filter("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("first"))  # two rows a partition at most
    open_ = streamed.filter("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).filter("doc > first")
    gone = streamed.filter("kind = 0").select("doc", "mark", "pos").unionByName(open_.select("doc", "mark", "pos"))
    by_doc = gone.groupBy("doc", "mark").agg(F.collect_list("pos").alias("at"))
    return by_doc.mapInArrow(_pack, "doc long, mark long, bitmap binary")


def mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, len(lines)
    keep = unpack(bitmap)
    return [x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :], len(lines)


def _join(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """All rows of ``docs`` with their bitmap (null: every line stays), and the name of its column."""
    doc, mark_, bitmap = free(docs, "doc", "mark", "bitmap").values()
    own = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), mark_: mark(text_col)})
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("mark").alias(mark_), F.col("bitmap").alias(bitmap))
    return own.join(maps, [doc, mark_], "left").drop(doc, mark_), bitmap


def apply(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what the bitmaps leave of the texts, all columns as they were, whatever their names; null texts stay null."""
    names = docs.columns
    schema = docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column(len(names)).to_pylist()
            texts = batch.column(at)
            if any(m is not None for m in maps):
                left = ["\n".join(keep_lines(t, m)[0]) if m is not None else t for t, m in zip(texts.to_pylist(), maps, strict=True)]
                texts = pa.array(left, texts.type)
            cols = [texts if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    joined, bitmap = _join(docs, bitmaps, id_col, text_col)
    return joined.select(*names, bitmap).mapInArrow(run, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, sha = [], [], []
        for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, total = keep_lines(text, bitmap)
            n.append(total)
            gone.append(total - len(kept))
            sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, "int64"), pa.array(gone, "int64"), pa.array(sha, "string")],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what :func:`keep_bitmaps` leaves of ``documents``; nulls, ties and empty tables as told there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    joined, bitmap = _join(docs, keep_bitmaps(docs), "doc_id", "text")
    return joined.select("doc_id", "text", bitmap).mapInArrow(
        _digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {"op10_line_dedup": ORACLE}
