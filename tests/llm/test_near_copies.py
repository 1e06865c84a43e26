"""Bands that are split over tasks give what whole ones give."""

import itertools
import random
import time

import numpy as np
import xxhash

import corpus_pipeline
from loomstat.llm import simhash

LEFT = "h long, f long, k1 long, k2 long, sketch binary"
MET = "h long, f long, k1 long, k2 long, a1 long, a2 long, late boolean, j int, sketch binary"


def met(spark, rows, k, least, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BAND", least)
    monkeypatch.setattr(simhash, "WHOLE", 0)
    df = spark.createDataFrame(rows, LEFT)
    return [tuple(r) for r in simhash._dealt(df, k, 4).mapInArrow(simhash._star(k), MET).collect()]


def test_five_thousand_unlike_texts_in_one_band(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(7, int(i), int(rng.integers(-(2**62), 2**62)), int(i), rng.bytes(simhash.SKETCH)) for i in rng.permutation(5000)]
    rows += [(100 + i // 3, i, i, i, rows[i][4]) for i in range(90)]  # small bands, three rows each
    rows += [(1000 + i, i, i, i, rows[i][4]) for i in range(50)]  # alone
    rows[1] = (*rows[1][:4], rows[0][4])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        for k in (1, 4, 16):
            split, whole = (sorted(met(spark, rows, k, least, monkeypatch), key=repr) for least in (20, 10**9))
            assert split == whole
            own = [r for r in split if r[7] == 0]
            assert len(own) == 5090 and {r[1:4] for r in own if r[0] == 7 and not r[6]} == {r[1:4] for r in sorted(rows[:5000], key=lambda r: r[1])[:k]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_third_are_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BAND", 10)
    monkeypatch.setattr(simhash, "WHOLE", 0)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words) + f" tail{i}") for i in range(300)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(100)]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(r["doc_id"] for r in left) == [0, *range(1000, 1100)]


def test_the_stage_finds_candidates_by_fingerprints(spark, monkeypatch):
    """With bands that no two texts share, copies within the radius are found all the same; no others are."""
    plain, rnd = simhash.bands, random.Random(5)

    def apart(text, width):
        hashes, sketch = plain(text, width)
        hashes = np.array([xxhash.xxh64_intdigest(text, b) for b in range(len(hashes))], "u8")  # of the text as a whole
        return hashes, sketch[: simhash.BITS] + hashes.astype("<u4").tobytes()

    monkeypatch.setattr(simhash, "bands", apart)
    word = lambda: f"w{rnd.randrange(10**9)}"
    rows = []
    for _ in range(60):
        text = [word() for _ in range(300)]
        copy = list(text)
        for i in rnd.sample(range(300), rnd.randint(1, 6)):
            copy[i] = word()
        rows += [" ".join(text), " ".join(copy)]
    rows = list(enumerate(rows))
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(root[:], 2):
        if (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS:
            root = [root[a] if r == root[b] else r for r in root]
    want = []
    for i, t in rows:
        if all(root[i] != root[j] or simhash.jaccard(t, rows[j][1], 5) < 0.8 for j in want):
            want.append(i)
    assert 60 < len(want) < 115
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_sketches_travel_for_shared_bands_alone(spark, monkeypatch):
    """Of 200 texts two are near copies: their common bands are dealt out, no band of another text."""
    plain, dealt = simhash._dealt, []

    def counted(left, k, parts):
        dealt.append([r["k1"] for r in left.select("k1").collect()])
        return plain(left, k, parts)

    monkeypatch.setattr(simhash, "_dealt", counted)
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(120)) for _ in range(199)]
    rows = list(enumerate([*texts, texts[50] + " end"]))
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(199))
    assert dealt[0] and all(len(set(keys)) <= 2 for keys in dealt)


def test_bands_of_texts_with_half_a_key_in_common(spark):
    """What one of them shares with a third text is not given to the other."""
    rows = [([1, 2, 3], b"a", 0, 7, 1), ([4, 5, 6], b"b", 1, 7, 2), ([1, 9, 5], b"c", 2, 8, 3), ([10], b"d", 3, 9, 4)]
    got = simhash._meeting(spark.createDataFrame(rows, "hs array<long>, sketch binary, _first long, k1 long, k2 long")).collect()
    assert sorted((r["_first"], r["hs"], r["early"], bytes(r["sketch"])) for r in got) == [(0, [1], [1], b"a"), (1, [5], [5], b"b"), (2, [1, 5], [1, 5], b"c")]


def test_shuffle_files_of_the_stage_go(spark):
    """Variants and bands are not on disk any more when the next query has ended, without a collection of garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        files = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(40))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    before, setting = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    for _ in range(100):  # files go in the background
        rest = sum(n for f, n in held().items() if f not in before)
        if rest < 100_000:
            break
        time.sleep(0.1)
    assert rest < 100_000  # variants alone are over 1,000,000 bytes
    assert spark.conf.get(setting, None) == was
    assert left.count() == 2000 == len(left.collect()) == len(left.collect())  # the frame is read again and again
