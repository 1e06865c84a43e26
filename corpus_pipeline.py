"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next.

Every stage keeps the columns it gets, whatever their names.  Null texts count as empty; an empty text is not toxic,
holds no benchmark item and has one line that stays; of several empty texts one stays after the near-copy stage, as
of other equal texts.  Of equal ids the texts decide; rows without id come last where order counts.  Repeated rows
are judged alike until the near-copy stage, which keeps one.  Ties go to the smaller id.  An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import common, decontaminate, line_dedup, mixing, simhash
from loomstat.llm import toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of a toxicity score of 0.5 or more, with a lexicon learnt from the labelled ones."""
    lexicon = tox.learn(docs, common.read(spark, sf_dir, "labels"))
    score = common.free(docs, "score")["score"]
    return tox.score(docs, lexicon, into=score).filter(F.col(score) < 0.5).select(*docs.columns)


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has; every document stays, ``n_chars`` follows its text."""
    out = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mixing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by raked weights."""
    return mixing.sample(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_),
]

#: Several stages (learnt scores, XXH64 fingerprints, edit distances) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared checkpoint folder."""
    docs = common.read(spark, sf_dir, "documents")
    done = None
    where = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{where}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:  # nothing reads it any more
            common.remove(spark, done)
        done = path
    return docs


QUERIES = {"pipeline": run}
