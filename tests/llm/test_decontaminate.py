"""Hashes against slices, matches against brute force on items of all lengths, long texts, and small bitmaps."""

import random

import numpy as np
import pytest

from loomstat.llm import decontaminate as d

SCHEMA = "doc_id long, text string"


def test_rolling_hashes_are_those_of_slices():
    rng = random.Random(0)
    text = "".join(rng.choice("ab é字𝒳") for _ in range(500))
    r = d.Rolling(text)
    for n in (1, 8, 13, 40):
        own = r.all(n)
        assert len(own) == 500 - n + 1
        assert all(own[i] == d.Rolling(text[i : i + n]).at(np.array([0]), n)[0] for i in range(0, 500 - n, 37))
        assert len({text[i : i + n] for i in range(500 - n + 1)}) == len(set(own.tolist()))
    assert len(d.Rolling("ab").all(8)) == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


@pytest.mark.parametrize("power", [3, 27])
def test_brute_force(spark, monkeypatch, power):
    """A bitmap of eight bits lets nearly all through; what is found is the same."""
    monkeypatch.setattr(d, "LEAST_POWER", power)
    monkeypatch.setattr(d, "MOST_POWER", power)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 1, 2, 3, 5, 8, 13, 30, 60])]
    docs = []
    for i in range(70):
        body = " ".join(word() for _ in range(rng.randint(0, 25)))
        own = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice("xyz ")
        docs.append((i, rng.choice(["", body + ", ", body]) + "".join(own).upper() + rng.choice(["", "! " + body, body])))
    want = set()
    for i, t in docs:
        for j, x in items:
            a, b = d.normalise(x), d.normalise(t)
            e = distance(a, b)
            if e <= d.errors_allowed(a, d.RATE):
                want.add((i, j, e))
    got = d.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want) > 40


def test_long_texts_and_short_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 100)
    item = "what is the boiling point of water at the top of a mountain"
    docs = [(1, "filler words " * 3000 + item + " tail " * 3000), (2, "Yes!"), (3, "yesterday"), (4, "oh yes indeed"), (5, None), (5, ""), (None, item), (1, "x")]
    bench = [(7, item), (8, "yes"), (8, "yes"), (9, None), (10, "?!")]
    got = d.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 7), (1, 7), (2, 8), (4, 8)]
    left = d.clean(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(1, "x"), (3, "yesterday"), (5, ""), (5, "")]
