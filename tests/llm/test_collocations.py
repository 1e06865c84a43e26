"""Collocations against a plain count, with bins so small that pivots are split, and on the cases that the docstring defines."""

import random
import re
from collections import Counter

import pytest

from loomstat.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, a int, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive(rows, least, top, held):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            own.update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            inside = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= held * a for b in inside):
                continue
            score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        n = 1 if i % 2 else 30
        words = [f"w{int(rng.paretovariate(0.7)) % n}" + rng.choice(["", "", "", ",", "\n", "\t ", "  ", "É"]) for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(words) + rng.choice(["", ". The Common line of All texts!", "\x0bx \x00 y\x85z"]), rng.choice(["a", "b", None]), "x", 1, 2))
    return rows + rows[:20]


@pytest.mark.parametrize("a_bin", [30, 100_000])
def test_brute_force(spark, a_bin, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 300)
    rows = texts()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=4, top=50, held=80, a_bin=a_bin)
    assert rows_of(got) == naive(rows, 4, 50, 80)


def test_split_pivots_and_pieces_over_chunks(monkeypatch):
    """The tasks' functions alone: every pivot is split, and fragments of all chunks give each n-gram's count."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK", 100)
    rows = texts()
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])

    class Sent:
        value = np.full(collocations.SLOTS, 1000, "u4")

    got = Counter()
    for out in collocations._route(Sent, 7, 10)([batch]):
        for lang, _, split, *rest in zip(*(c.to_pylist() for c in out.columns), strict=True):
            assert split
            for text, n in zip(*collocations.mine([tuple(rest)], 4, split), strict=True):
                got[lang, text.decode()] += n
    want = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            want.update((lang or "und", " ".join(w[i : i + m])) for m in (2, 3, 4) for i in range(len(w) - m + 1))
    assert got == want


def test_defined_cases(spark):
    long_ = "one two " * 40000
    rows = [(1, None, "a", "", 0, 0), (None, "", "a", "", 0, 0), (3, long_, None, "", 0, 0), (4, long_, "und", "", 0, 0), (5, ". , \n", "c", "", 0, 0)]
    got = rows_of(collocations.collocations(spark.createDataFrame(rows, SCHEMA)))
    assert got == naive(rows, 30, 2000, 80) and {r[0] for r in got} == {"und"}
    assert not collocations.collocations(spark.createDataFrame([], SCHEMA)).collect()


def test_many_languages(monkeypatch):
    """More languages than a task holds at once: what it holds is bounded, what it counts is the same."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK", 400)
    monkeypatch.setattr(collocations, "VOCABULARY", 50)
    rng = random.Random(8)
    rows = [(f"l{rng.randrange(40)}", " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40)))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    got = Counter()
    for out in collocations._count_words([batch]):
        assert out.num_rows <= 200
        for lang, word, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[lang, word] += n
    assert got == Counter((lang, w) for lang, text in rows for w in text.split())
