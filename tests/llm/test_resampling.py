"""Resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_n, buckets):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, max_n, buckets, percent, min_words, seed):
    held = [(i, *features(t, max_n, buckets)) for i, t in docs]
    s, t = Counter(f for _, _, fs in held for f in fs), Counter(f for x in target for f in features(x, max_n, buckets)[1])
    total, goal = sum(s.values()), sum(t.values())
    out = []
    for i, n, fs in held:
        weight = sum(math.floor(1000 * math.log((t[f] + 1) * (total + buckets) / ((s[f] + 1) * (goal + buckets)))) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    for k, x in enumerate(order[: percent * len(order) // 100]):
        x[5] = k + 1
    return sorted(out, key=str)


TEXTS = ["The cat sat on the mat, the CAT", "naïve Ünïcode wörds 123 a_b", "the the the the", "", None, "x" * 5000 + " the cat", "\x00nul\x00 the\tcat", "don't STOP", "日本語 the cat sat"]


@pytest.mark.parametrize("max_n", [1, 2, 3])
@pytest.mark.parametrize("head", [0, 2, 1000])  # every feature of the tail; both; hardly any
def test_equals_plain_python(spark, max_n, head):
    docs = [(i, f"{TEXTS[i % len(TEXTS)] or ''} word{i % 11} " * (i % 5)) for i in range(120)] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    docs += [(5, docs[5][1]), (None, "the cat sat on"), (None, "the cat sat on")]
    target = ["The cat sat.", "the mat word3 word3", None, "naïve wörds"]
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in docs], "doc_id long, text string, rank string, score int, weight int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, max_n=max_n, buckets=50, percent=30, min_words=3, seed=9, head=head)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((list(r) for r in got.collect()), key=str) == brute(docs, target, max_n, 50, 30, 3, 9)


def test_many_buckets_and_the_drawn(spark):
    docs = [(i, f"w{i} w{i * 7 % 50} the cat sat") for i in range(60)]
    df = spark.createDataFrame([(i, t, i * 2) for i, t in docs], "doc_id long, text string, more long")
    goal = spark.createDataFrame([("the cat w7 w8",)], "text string")
    got = resampling.resample(df, goal, max_n=2, buckets=1 << 20, percent=10, min_words=5, seed=1)
    assert sorted((list(r) for r in got.collect()), key=str) == brute(docs, ["the cat w7 w8"], 2, 1 << 20, 10, 5, 1)
    rows = resampling.drawn(spark, df, got).collect()
    assert len(rows) == 6 and rows[0].asDict().keys() == {"doc_id", "text", "more"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, goal).collect() == []
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    got = resampling.resample(some, none, percent=100).collect()
    assert [list(r) for r in got] == brute([(1, "a b " * 20)], [], 1, 10_000, 100, 20, 2024)


def test_a_head_is_what_is_frequent(spark):
    df = spark.createDataFrame([(f"common rare{i} common also " + "y" * 200,) for i in range(50)], "text string").repartition(4)
    head = resampling.find_head(df, max_n=2, size=8)
    assert set(head.words) == {b"common", b"also"} and set(head.pairs) == {(b"common", b"also")}  # the long word is never in it


def test_long_texts_are_whole(spark):
    text = "alpha beta gamma " * 300_000
    got = resampling.resample(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("alpha",)], "text string")).collect()
    assert got[0]["n_features"] == 900_000
