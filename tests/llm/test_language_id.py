"""Phrases and winners of several languages against a plain parse; scripts of thousands of letters; passes over groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import language_id
from loomstat.llm.common import held_out

DOCS = "doc_id long, text string, lang string"


def naive(ref, text):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in ref:
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("segment", [7, 64, 1024])
def test_phrases_over_segments(segment, monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    rng = np.random.default_rng(0)
    for symbols in (3, 6, 40):
        own = rng.integers(0, symbols, 400)
        a = language_id.automaton(own, symbols + 2)
        ref = "".join(map(chr, own + 65))
        # texts of pieces of the reference have phrases that pass over segments
        texts = [rng.integers(0, symbols + 1, n) for n in (0, 1, 5, 63, 64, 65, 1500)] + [np.concatenate([own[k : k + 200] for k in rng.integers(0, 200, 12)]), np.zeros(3000, "i8"), own]
        got, _ = language_id.phrases(a, texts)
        assert got.tolist() == [naive(ref, "".join(map(chr, t + 65))) for t in texts]
        monkeypatch.setattr(language_id, "SYMBOLS", 50)
        assert language_id._counts([a, a], texts).tolist() == [[n, n] for n in got.tolist()]
        monkeypatch.undo()
        monkeypatch.setattr(language_id, "SEGMENT", segment)


def languages():
    """Six languages of Latin letters and two scripts of 3,000 letters each."""
    rng = random.Random(1)
    sounds = [[rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s"]) for _ in range(25)] for _ in range(6)]
    word = {f"l{i}": lambda s=s: "".join(rng.choices(s, k=rng.randint(1, 3))) for i, s in enumerate(sounds)}
    for name, start in (("han", 0x4E00), ("hangul", 0xAC00)):
        word[name] = lambda start=start: "".join(chr(start + int(rng.paretovariate(0.3)) % 3000) for _ in range(rng.randint(1, 4)))
    return {k: lambda n, w=w: " ".join(w() for _ in range(n)) for k, w in word.items()}


def test_winners_of_many_scripts(spark):
    made = languages()
    rows = [(i, made[lang](random.Random(i).choice([30, 80, 400])), lang) for i, lang in enumerate(list(made) * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    models = language_id.learn(docs)
    assert models.langs == sorted(made) and len(models.letters) > 3000
    one, three = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, models, langs_a_pass=n).collect()} for n in (32, 3))
    assert all(one[i][0] == three[i][0] and abs(one[i][1] - three[i][1]) < 1e-9 for i in one)
    assert all(one[i][0] == lang for i, _, lang in rows) and all(0 < s <= 1 for _, s in one.values())
    # the winner is that of a plain parse of the reference texts
    some = language_id._sample(docs, "doc_id", "text", "lang").orderBy("lang", "least").collect()
    codes = language_id.code_table(models.letters)
    symbols = lambda t: "".join(map(chr, language_id._symbols(codes[language_id._points(t)])))
    refs = {k: symbols(" ".join(r["text"] for r in some if r["lang"] == k))[: language_id.REFERENCE] for k in made}
    for i, text, _ in rows[:24]:
        t = symbols(text)
        entropy = {k: naive(ref, t) * np.log2(len(ref)) / len(t) for k, ref in refs.items()}
        want = min(sorted(entropy), key=entropy.get)
        share = sum(np.exp(4 * (entropy[want] - e)) for e in entropy.values())
        assert one[i][0] == want and abs(one[i][1] - 1 / share) < 1e-9


def test_defined_cases(spark):
    made = languages()
    rows = [(i, made["l0"](50) if i % 2 else made["l1"](50), "l0" if i % 2 else "l1") for i in range(60)]
    odd = [(None, made["l0"](40), None), (100, None, "l0"), (101, "", None), (102, "12 . !", None), (103, made["l1"](40000), None), (104, "ж", None)]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("best", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (None, 100, 101, 102, 103)] == ["l0", "und", "und", "und", "l1"]
    assert [got[i]["score"] for i in (100, 101, 102)] == [0, 0, 0] and got[104]["lang_pred"] in ("l0", "l1")
    held = {r["doc_id"] for r in docs.filter(held_out(F.col("doc_id"))).collect()}
    only_held = language_id.learn(docs.filter(held_out(F.col("doc_id"))))
    assert held and only_held.langs == [] and {r["lang_pred"] for r in language_id.predict(docs, only_held).collect()} == {"und"}
