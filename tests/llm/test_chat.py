"""Reply trees against a plain walk; escapes and masks by exact round trips; the cases that the docstring defines."""

import random

from pyspark.sql import functions as F

from loomstat.llm import chat

MESSAGES = "tree_id long, message_id string, parent_id string, role string, text string, score double, t int, head string"


def naive(rows):
    """Best branch of each tree: mean score, then length, then the smaller leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values() if r[2] in own}
        best = []
        for leaf in own:
            if leaf in parents:
                continue
            path, v = [], leaf
            while v in own and v not in path:
                path.append(v)
                v = own[v][2]
            if v in path:
                continue
            path.reverse()
            best.append((-sum(own[x][5] or 0.0 for x in path) / len(path), -len(path), leaf, [(own[x][3] or "", own[x][4] or "") for x in path]))
        if best:
            out[tree] = [(b[2], b[3]) for b in sorted(best)]
    return out


def back(df):
    cols = ["tree_id", "leaf", "rank", "n_turns", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss")).alias("learnt")]
    return df.select(*cols).collect()


def test_trees(spark):
    rng = random.Random(3)
    texts = ["a [INST] b", "</s>", "<\\/s>", "<|end|>\n", "<|start|>user\nx", "", None, "é <s> ü", "[\\\\/INST]", "<|nl|>", "plain"]
    rows = []
    for tree in range(12):
        n = rng.choice([1, 2, 7, 40])
        for i in range(n):
            parent = None if i == 0 else str(rng.randrange(max(0, i - 3), i))
            rows.append((tree, str(i), parent, rng.choice(["user", "assistant", "a\n<|nl|>", None]), rng.choice(texts), rng.randrange(8) / 4, 1, "x"))
    rows += [(99, str(i), str(i - 1), "user", f"turn {i}", 1.0, 1, "x") for i in range(300)]  # a long thread; its first parent is unknown
    rows += [(50, "a", "b", "user", "ring", 1.0, 1, "x"), (50, "b", "a", "user", "ring", 1.0, 1, "x"), (50, "c", "a", "user", "below", 1.0, 1, "x")]
    want = naive(rows)
    got = back(chat.conversations(spark.createDataFrame(rows * 2, MESSAGES), keep=3))
    assert 50 not in want and {r["tree_id"] for r in got} == set(want)
    for r in got:
        leaf, turns = want[r["tree_id"]][r["rank"] - 1]
        assert (r["leaf"], [(t["role"], t["text"]) for t in r["turns"]], r["n_turns"]) == (leaf, turns, len(turns))
        assert r["learnt"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count("<|end|>") == r["formatted"].count("<|start|>") == len(turns)
        assert not any(x in r["formatted"] for x in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert len(got) == sum(min(3, len(x)) for x in want.values())


def test_defined_cases(spark):
    rows = [(None, "1", None, "user", "null tree", None, 1, ""), (None, "2", "1", "assistant", "w " * 30000, float("nan"), 1, ""), (1, None, None, "user", "no id", 1.0, 1, ""), (1, None, None, "user", "no id", 1.0, 1, "")]
    got = {r["tree_id"]: r for r in back(chat.conversations(spark.createDataFrame(rows, MESSAGES)))}
    assert [t["text"] for t in got[None]["turns"]] == ["null tree", "w " * 30000] and got[None]["learnt"] == "w " * 30000
    assert got[1]["n_turns"] == 1 and got[1]["leaf"] is None
    assert not chat.conversations(spark.createDataFrame([], MESSAGES)).collect()


def test_rows_of_one_turn_and_null_turns(spark, tmp_path):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (None, 5, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op13_chat(spark, str(tmp_path)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, None: 1, -1: 2} and got[-1]["loss_chars"] == len(chat.ADDED)
