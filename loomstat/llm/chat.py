"""Reply trees: self-joins that double their reach find root-to-leaf paths, the best branches become conversations.

After round k a message knows its ancestor 2^k replies up and the scores between, so a thread of n replies takes
log2(n) joins.  Leaves are ranked by what their paths score.  Chosen leaves then go back through the rounds: every
distance to an ancestor is one sum of powers of two, so each message of a chosen path is met once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, read

#: What marks turns; the strings that models take as control, after the character that opens them.
START, END, NEWLINE = "<|start|>", "<|end|>\n", "<|nl|>"
OPENS, CONTROL = r"[<\[]", r"s>|/s>|INST\]|/INST\]|\|[a-z_]+\|>"


def escape(text: Column) -> Column:
    """``text`` without control strings: each gets one more backslash after its first character."""
    return F.regexp_replace(text, rf"({OPENS})(\\*)({CONTROL})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENS})(\\*)\\({CONTROL})", "$1$2$3")


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))


def _key(c: Column) -> Column:
    """A value or null as text that is never null."""
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """``t``, ``leaf``, ``v``, ``pos``, ``score``, ``rank``: the messages of the ``keep`` best branches of each tree.

    ``nodes`` has ``t``, ``v`` (unique in ``t``), ``p`` and ``s``.  A message without a known parent is a root.  Rows that
    reply in a ring have no root and are on no path.
    """
    parents = nodes.select(F.col("t").alias("bt"), F.col("v").alias("bv"))
    state = nodes.join(parents, (F.col("t") == F.col("bt")) & (F.col("p") == F.col("bv")), "left")
    state = cut(state.select("t", "v", F.col("bv").alias("up"), F.col("s").alias("sum"), F.lit(1).cast("long").alias("len")))
    leaves = state.select("t", "v").join(state.select("t", F.col("up").alias("v")), ["t", "v"], "left_anti")
    levels, last = [], -1
    while True:
        left = state.filter("up IS NOT NULL")
        n = left.count()
        if n in (0, last):  # all are at a root; or what is left goes round in rings, else the nearest ones had ended
            break
        levels.append(left.select("t", "v", "up"))
        last = n
        above = state.select(*[F.col(c).alias(f"b{c}") for c in state.columns])
        # rows that are at a root go no further
        far = left.join(above, (F.col("t") == F.col("bt")) & (F.col("up") == F.col("bv")))
        far = far.select("t", "v", F.col("bup").alias("up"), *[(F.col(c) + F.col(f"b{c}")).alias(c) for c in ("sum", "len")])
        state = cut(state.filter("up IS NULL").unionByName(far))
    ends = state.filter("up IS NULL").join(leaves, ["t", "v"], "left_semi")
    ends = ends.select("t", F.col("v").alias("leaf"), "v", (F.col("len") - 1).alias("pos"), (F.col("sum") / F.col("len")).alias("score"))
    best = Window.partitionBy("t").orderBy(F.desc("score"), F.desc("pos"), "leaf")
    marks = cut(ends.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep))
    for k in reversed(range(len(levels))):
        up = marks.join(levels[k], ["t", "v"]).select("t", "leaf", F.col("up").alias("v"), (F.col("pos") - (1 << k)).alias("pos"), "score", "rank")
        marks = cut(marks.unionByName(up))
    return marks


def conversations(
    messages: DataFrame,
    *,
    tree: str = "tree_id",
    node: str = "message_id",
    parent: str = "parent_id",
    role: str = "role",
    text: str = "text",
    score: str | None = "score",
    learn: str = "assistant",
    keep: int = 1,
) -> DataFrame:
    """One row for each of the ``keep`` best branches of a tree, as ``formatted`` text.

    Columns: tree, ``leaf`` (id of its last message), ``rank``, ``branch_score`` (mean of its messages), ``n_turns``,
    ``formatted`` and ``loss`` (``start``, ``stop`` in bytes of the escaped texts of role ``learn``, in order).  Equal scores:
    the longer branch, then the smaller id as text.

    Null roles and texts are empty, null and NaN scores 0, a null tree is a tree of its own.  Of rows that share an id the
    smallest stays; rows without id are told apart by what they say and have no replies.  Unknown parents make
    roots; rings of replies have no root and give nothing.  Texts of any length pass; a conversation is one row.  Empty
    tables give an empty result; other columns are not read, whatever their names.
    """
    said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    points = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)) if score else F.lit(0.0)
    told = F.sha2(F.to_json(F.struct(F.col(parent).alias("p"), said[0].alias("r"), said[1].alias("x"))), 256)
    own = messages.select(
        _key(F.col(tree)).alias("t"),
        F.when(F.col(node).isNull(), F.concat(F.lit("n"), told)).otherwise(_key(F.col(node))).alias("v"),
        F.struct(
            F.when(F.col(parent).isNotNull(), _key(F.col(parent))).alias("p"),
            points.alias("s"),
            said[0].alias("role"),
            said[1].alias("text"),
            F.col(tree).alias("tree"),
            F.col(node).alias("node"),
        ).alias("m"),
    )
    own = cut(own.groupBy("t", "v").agg(F.min("m").alias("m")).select("t", "v", "m.*"))
    chosen = paths(own.select("t", "v", "p", "s"), keep)
    turns = chosen.join(own.drop("p", "s"), ["t", "v"])
    turns = turns.withColumns({"head": _head(F.col("role")), "body": escape(F.col("text"))})
    piece = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("t", "leaf").orderBy("pos")
    size = lambda c: F.octet_length(c).cast("long")
    turns = turns.withColumn("start", F.sum(size(piece)).over(before) - size(F.concat("body", F.lit(END))))
    turns = turns.withColumn("stop", F.col("start") + size(F.col("body")))
    learnt = F.when(F.col("role") == learn, F.struct("pos", "start", "stop"))
    out = turns.groupBy("t", "leaf").agg(
        F.first("tree").alias("tree"),
        F.max_by("node", "pos").alias("leaf_id"),
        F.first("rank").alias("rank"),
        F.first("score").alias("branch_score"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("pieces"),
        F.sort_array(F.collect_list(learnt)).alias("loss"),
    )
    return out.select(
        F.col("tree").alias(tree),
        F.col("leaf_id").alias("leaf"),
        "rank",
        "branch_score",
        "n_turns",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.transform("loss", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("loss"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of ``role`` and ``text``."""

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)
        text = F.substr(x, F.locate("\n", x) + 1)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return let(F.split(formatted, r"\Q" + END + r"\E"), lambda parts: F.transform(F.slice(parts, 1, F.size(parts) - 1), turn))


def learnt_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its spans."""
    cut_out = lambda b: F.transform(loss, lambda s: unescape(F.decode(F.substring(b, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")), "UTF-8")))
    return let(formatted.cast("binary"), lambda b: F.array_join(cut_out(b), ""))


#: The conversation that the contract adds: control strings inside its texts.
ADDED = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from :func:`conversations`, of all ``conversations`` and of conversation -1.

    A turn replies to the one before it (by turn, role and text; null turns first), so that equal rows are turns of
    their own and each tree has one branch.  Else nulls, long texts and empty tables as told there.
    """
    added = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{ADDED}'), (-1L, 1L, 'assistant', '{ADDED}') AS t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", at).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    made = conversations(rows, tree="conv_id", node="node", parent="parent", score=None)
    back = made.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), learnt_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hashed(F.array_join(said, "")).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        hashed(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{ADDED}'), (-1, 1, 'assistant', '{ADDED}'))),
e AS (SELECT *, regexp_replace(role, '({OPENS})(\\*)({CONTROL})', '\1\2\\\3', 'g') AS er, regexp_replace(text, '({OPENS})(\\*)({CONTROL})', '\1\2\\\3', 'g') AS ex FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 1} + length(er) + {len(NEWLINE) - 1} * (length(er) - length(replace(er, chr(10), ''))) + length(ex))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
QUERIES = {"op13_chat": op13_chat}
ORACLES = {"op13_chat": ORACLE}
