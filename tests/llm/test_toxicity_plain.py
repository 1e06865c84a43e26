"""The matcher of the lexicon against a plain one, over words of any length."""

import math
import random

import pytest

from loomstat.llm import toxicity

TERMS = {"bad": (2.0, False), "badly": (3.0, False), "idi": (1.5, True), "idiot": (2.5, False), "x" * 60: (4.0, False), "aa": (1.0, False), "aaa": (0.5, True)}


def plain(lex, text):
    """Words one by one: of the terms that a word is, or begins with, the heaviest counts, unless its neighbours excuse it."""
    ws = toxicity.fold(text).split()
    total, found = 0.0, []
    for i, w in enumerate(ws):
        own = [(weight, t) for t, (weight, stem) in lex.terms.items() if w == t or stem and w.startswith(t)]
        if not own:
            continue
        before, after = ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else ""
        weight = max(x for x, _ in own)
        found.append((weight, before, w, after))
        if f"{before} {w}" not in lex.exceptions and f"{w} {after}" not in lex.exceptions:
            total += weight
    return found, (math.log1p(total), math.log1p(100 * total / max(len(ws), 20)))


@pytest.mark.parametrize("exceptions", [frozenset(), frozenset({"not bad", "idiot proof", "aa aaa"})])
def test_matcher(exceptions):
    lex = toxicity.Lexicon(TERMS, exceptions)
    rng = random.Random(7)
    words = ["bad", "badly", "b4d", "BAD", "idiot", "1diot", "idiotic", "idiom", "proof", "not", "x" * 60, "x" * 61, "aa", "aaa", "aaaa", "good", "ba", "d", "іdiot", "bad!", "(bad)"]
    for n in [0, 1, 2, 5, 40, 300]:
        for _ in range(40):
            text = rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(n))
            found, features = plain(lex, text)
            got = sorted((lex.terms[t][0], b, w, a) for t, b, w, a in lex.hits(toxicity.fold(text)))
            assert got == sorted(found)
            assert all(abs(x - y) < 1e-9 for x, y in zip(lex.features(text), features, strict=True))


def test_long_words_are_learnt(spark):
    long_ = "z" * 55
    rows = [(i, f"some plain text {i} here" + (f" {long_}" if i % 2 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    lex = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert any(long_.startswith(t) for t in lex.terms) and lex.score(f"now {long_} again") > 0.5 > lex.score("now plain again")
