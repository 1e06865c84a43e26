"""Line-preserving repair of JSON lines: what cannot be repaired passes unchanged, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import PLACEHOLDER_OPTIONS, TOPICS

ROW = "instruction string, input string, output string"


def repair(lines: DataFrame) -> DataFrame:
    """``raw`` lines with ``line_no`` -> ``line_no``, ``line``, ``repaired``."""
    topics = F.broadcast(lines.sparkSession.createDataFrame([(d, t) for t, d, _, _ in TOPICS], "name string, topic string"))
    row = F.from_json("raw", ROW)
    parsed = lines.select("line_no", "raw", row.alias("r")).withColumn("name", F.trim(F.regexp_extract("r.input", r"Topic:\s*(.+)\z", 1)))
    joined = parsed.join(topics, "name", "left")
    output = F.struct(
        F.col("r.output").alias("questionText"),
        F.array(*map(F.lit, PLACEHOLDER_OPTIONS)).alias("options"),
        F.lit("B").alias("correctAnswer"),
        F.col("topic"),
        F.lit(True).alias("formatted"),
        F.lit(True).alias("needsGeminiRefinement"),
    )
    new = F.to_json(F.struct(F.col("r.instruction").alias("instruction"), F.col("r.input").alias("input"), output.alias("output")))
    good = F.col("topic").isNotNull() & F.col("r.output").isNotNull()
    return joined.select("line_no", F.when(good, new).otherwise(F.col("raw")).alias("line"), good.alias("repaired"))
