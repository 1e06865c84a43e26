"""Parts of the suffix index against plain ones."""

import random

import numpy as np
import pyarrow as pa

from loomstat.llm import suffix_dedup


def rows(texts, bounds=()):
    n = len(texts)
    cols = [pa.array(range(n), "int64"), pa.array([-i for i in range(n)], "int64"), pa.array(texts, "string"), pa.array([64 * i for i in range(n)], "int64")]
    return list(suffix_dedup._snippets(200, list(bounds))(iter([pa.RecordBatch.from_arrays(cols, ["k1", "k2", "text", "salt"])])))


def test_snippets_of_many_texts_are_given_together(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(150, 600))) for _ in range(100)] + [None, ""]
    whole = rows(texts, [-5, 0, 0, 9])
    assert len(whole) == 1
    monkeypatch.setattr(suffix_dedup, "ROWS", 1)
    single = rows(texts, [-5, 0, 0, 9])
    assert len(single) > 50 and pa.Table.from_batches(single).to_pylist() == whole[0].to_pylist()
    assert rows([None, "short"]) == []


def test_matching_statistics_brute_force():
    rnd = random.Random(6)
    for n in (1, 2, 3, 8, 40, 200):
        for symbols in ("a", "ab", "ab\0", "abcdefgh"):
            t = "".join(rnd.choice(symbols) for _ in range(n)).encode() + b"\xff"
            got = suffix_dedup.RunIndex(np.frombuffer(t, "u1")).matching_statistics(30)
            for p in range(len(t)):
                best = max((next((i for i in range(len(t)) if max(p, q) + i >= len(t) or t[p + i] != t[q + i]), 0) for q in range(len(t)) if q != p), default=0)
                assert min(got[p], 30) == min(best, 30), (t, p)
