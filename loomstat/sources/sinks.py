"""Sinks for ``foreachBatch`` in which a replayed batch changes nothing, retention by folder names, and long JSON documents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.newest import newest
from .snapshots import Snapshots

Sink = Callable[[DataFrame, int], None]


def log_sink(path: str, *, ts: str = "ts", days: int | None = None, form: str = "parquet") -> Sink:
    """Adds records to a log by day and batch (``form``: parquet or json); then drops days older than ``days``.

    A batch owns its folders ``day=/batch=``, so writing it again replaces what it wrote.  Rows without time go to the
    folder of null days, which is never too old.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.withColumns({"day": F.to_date(ts), "batch": F.lit(batch_id)})
        out = own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
        out.format(form).save(path)
        if days is not None:
            drop_days(batch.sparkSession, path, days)

    return write


def drop_days(spark: SparkSession, path: str, days: int) -> list[str]:
    """Drops the folders of days more than ``days`` before the newest; names are read, never the log."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    known = {}
    for status in fs.listStatus(to(path)):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:5].isdigit():
            known[date.fromisoformat(name[4:])] = status.getPath()
    gone = [d for d in sorted(known) if d < max(known) - timedelta(days=days)]
    for d in gone:
        fs.delete(known[d], True)
    return [str(d) for d in gone]


def retention_sink(path: str, *, n: int, age_seconds: int, ts: str = "ts", id_col: str = "id", keep_versions: int = 2) -> Sink:
    """Keeps the newest ``n`` records not older than ``age_seconds`` behind the newest, as a versioned table.

    What is kept of two sets follows from what is kept of each, so the state is never more than ``n`` rows, whatever the
    stream has had.  A batch that the live version has seen already is passed over.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        live = Snapshots(batch.sparkSession, path)
        seen = live.manifest()
        if seen is not None and seen.get("batch", -1) >= batch_id:
            return
        rows = batch if seen is None else live.read().unionByName(batch)
        live.commit(newest(rows, n=n, age_seconds=age_seconds, ts=ts, id_col=id_col), base=0 if seen is None else seen["version"], batch=batch_id)
        live.vacuum(keep_versions)

    return write


def write_document(path: str, sections: dict[str, DataFrame | Column | str], *, spark: SparkSession, rows_a_part: int = 1_000_000) -> None:
    """One JSON object in parts that follow one another by name: lines of text, read together they are the document.

    A section is a DataFrame (an array with an object for each row, in the order of its columns ``_order``, which are left
    out) or a JSON text.  Head, separators and tail are rows like others, so no row ever holds a table.
    """
    lines = document_lines(sections, spark)
    n = lines.count()
    parts = max(1, -(-n // rows_a_part))
    lines.repartitionByRange(parts, "section", "place", "order", "line").sortWithinPartitions("section", "place", "order", "line").select("line").write.mode("overwrite").text(path)


def document_lines(sections: dict[str, DataFrame | str], spark: SparkSession) -> DataFrame:
    """``section``, ``place`` (0: head, 1: rows, 2: tail), ``order`` and ``line`` of a document."""
    out, edges = [], []
    names = list(sections)
    for i, name in enumerate(names):
        comma = "" if i == len(names) - 1 else ","
        what = sections[name]
        opens = ("{" if i == 0 else "") + f'"{name}":'
        ends = comma + ("}" if i == len(names) - 1 else "")
        if isinstance(what, DataFrame):
            edges += [(i, 0, "", opens + "["), (i, 2, "", "]" + ends)]
            own = [c for c in what.columns if c != "_order"]
            row = what.select(F.col("_order").cast("string").alias("order"), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("json"))
            first = row.agg(F.min(F.struct("order", "json")).alias("first"))  # the first row has no comma before it
            row = row.crossJoin(F.broadcast(first))
            mark = F.when(F.struct("order", "json") == F.col("first"), "").otherwise(",")
            out.append(row.select(F.lit(i).alias("section"), F.lit(1).alias("place"), "order", F.concat(mark, "json").alias("line")))
        else:
            edges.append((i, 0, "", opens + what + ends))
    frame = spark.createDataFrame(edges, "section int, place int, order string, line string")
    for o in out:
        frame = frame.unionByName(o)
    return frame
