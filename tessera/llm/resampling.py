"""Importance resampling towards a target: hashed n-grams of both corpora, counted in buckets, weigh the documents of one.

A feature's bucket is the crc32 of its bytes modulo the number of buckets. The words and pairs that fill most of a corpus (the
head) are broadcast with their crc states, from which longer n-grams go on; all others (the tail) take the crc of their
bytes. Both give the same numbers, so bucket totals are exact whatever is in the head.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, spread, stored, texts

#: Longest n-gram, buckets, and words that a document needs to be drawn.
MAX_N, BUCKETS, MIN_WORDS = 1, 10_000, 20
#: Share of the eligible documents that is drawn, in hundredths, and the seed of the draw.
PERCENT, SEED = 10, 2024
#: Words in the head and pairs in the head at most. None has words of more than LONGEST bytes on average, so that what is broadcast has some 13 MB at most.
HEAD, LONGEST = 1 << 15, 64
#: Distinct words that a task counts at once while it looks for frequent ones.
COUNTED = 1 << 18

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Digits, letters a to z (A to Z become these) and all beyond ASCII make words; every other character parts them."""
    return text.translate(_FOLD).split()


class Words(dict):
    """crc states of words: those of the head are looked up, any other is worked out."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Pairs(dict):
    """crc states of pairs of words; one outside the head goes on from its first word's state."""

    def __init__(self, head: dict, words: Words) -> None:
        super().__init__(head)
        self.words = words

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" " + pair[1], self.words[pair[0]])


class Vocabulary:
    """The head, as tasks use it. Without one every feature is of the tail."""

    def __init__(self, words: list[bytes] = (), pairs: list[tuple[bytes, bytes]] = ()) -> None:
        self.words = Words((w, zlib.crc32(w)) for w in words)
        self.pairs = Pairs({p: zlib.crc32(b" " + p[1], self.words[p[0]]) for p in pairs}, self.words)

    def features(self, words: list[bytes], max_n: int) -> np.ndarray:
        """The crc of every run of 1 to max_n words."""
        states = list(map(self.words.__getitem__, words))
        out = [np.array(states, np.uint32)]
        if max_n > 1 and len(words) > 1:
            states = list(map(self.pairs.__getitem__, zip(words, words[1:], strict=False)))
            out.append(np.array(states, np.uint32))
        for n in range(3, min(max_n, len(words)) + 1):
            states = [zlib.crc32(b" " + w, s) for w, s in zip(words[n - 1 :], states, strict=False)]
            out.append(np.array(states, np.uint32))
        return np.concatenate(out)


def _frequent(counts: Counter, most: int) -> Counter:
    return Counter(dict(counts.most_common(most)))


def find_head(docs: DataFrame, text: str = "text", max_n: int = MAX_N, size: int = HEAD) -> Vocabulary:
    """The words, and pairs if n-grams have two words or more, that are at least one in size of all: so size of them at most.

    A task counts up to COUNTED distinct items, lets the rarer half go beyond twice that, and reports those that are one in size of its own; these are
    summed over the tasks. So what is frequent everywhere is found; a rare miss costs time, not correctness.
    """
    width = min(max_n, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = [Counter() for _ in range(width)], [0] * width
        for batch in batches:
            for b in texts(batch.column(0)):
                words = words_of(b)
                for n, c in enumerate(counts):
                    seen[n] += max(0, len(words) - n)
                    for at in range(0, len(words), COUNTED):
                        part = words[at : at + COUNTED + n]
                        c.update(zip(part, part[1:], strict=False) if n else part)
                        if len(c) > 2 * COUNTED:
                            counts[n] = c = _frequent(c, COUNTED)
        for n, c in enumerate(counts):
            best = [(b" ".join(w) if n else w, k) for w, k in c.items() if k * size >= seen[n] and (sum(map(len, w)) if n else len(w)) <= LONGEST * (n + 1)]
            items, numbers = [None, *(w for w, _ in best)], [seen[n], *(k for _, k in best)]  # without an item: of all
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(items), pa.int32()), pa.array(items, pa.binary()), pa.array(numbers, pa.int64())], names=["n", "item", "k"])

    if not size:
        return Vocabulary()
    each = spread(docs.select(F.col(f"`{text}`").cast("string").alias("t"))).mapInArrow(run, "n int, item binary, k long")
    total = stored(each.groupBy("n", "item").agg(F.sum("k").alias("k")))
    all_ = total.filter("item is null").select("n", F.col("k").alias("seen"))
    rows = total.filter("item is not null").join(F.broadcast(all_), "n").filter(F.col("k") * size >= F.col("seen")).collect()  # size of each n at most
    best = [[bytes(r["item"]) for r in rows if r["n"] == n] for n in range(width)]
    return Vocabulary(best[0], [tuple(x.split(b" ")) for x in best[1]] if width > 1 else [])


def hashed(docs: DataFrame, head: Vocabulary, keep: list[str], text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """The kept columns, n_words, n_features and the buckets of all features, as little-endian numbers of 4 bytes (2 where enough)."""
    vocabulary, kind = docs.sparkSession.sparkContext.broadcast((list(head.words), list(head.pairs))), "<u2" if buckets <= 1 << 16 else "<u4"
    names = [*keep, "n_words", "n_features", "buckets"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words long, n_features long, buckets binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(*vocabulary.value)
        for batch in batches:
            rows = []
            for b in texts(batch.column(len(keep))):
                words = words_of(b)
                f = known.features(words, max_n)
                rows.append((len(words), len(f), (f % np.uint32(buckets)).astype(kind).tobytes()))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=names)

    rows = spread(docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].cast("string").alias(fresh(docs, "text_in")[0])))
    return rows.mapInArrow(run, schema)


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all rows of hashed() have in each bucket: a histogram per task, summed by bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in texts(batch.column(0)):
                total += np.bincount(np.frombuffer(b, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "k"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket long, k long").groupBy("bucket").agg(F.sum("k").alias("k")).collect():  # one row a bucket
        out[r["bucket"]] = r["k"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, with one feature more in every bucket."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns and weight, the sum of a row's gains."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    table = features.sparkSession.sparkContext.broadcast(gain)
    schema = ", ".join([*(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep), "weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(table.value[np.frombuffer(b, kind)].sum()) for b in texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(weight, pa.int64())], names=[*keep, "weight"])

    return features.select(*keep, "buckets").mapInArrow(run, schema)


def noise(key: str, seed: int) -> F.Column:
    """Thousandths of a Gumbel number that a key and a seed decide; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(unit))).cast("long")


def ranked(rows: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds rank to rows of (uid, n_words, score, doc_id): places by falling score among those with enough words, null beyond the drawn.

    Rows are dealt by ranges of the order and numbered within; how many each range holds (one row a range) gives its first number.
    """
    spark = rows.sparkSession
    last = (F.col("n_words") < min_words).alias("last")
    order = [F.col("last"), F.col("score").desc(), F.col("doc_id"), F.col("uid")]
    dealt = rows.select("*", last).repartitionByRange(*order).sortWithinPartitions(*order)
    # a place is the range's number, shifted, and the row's in it
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))
    before, sizes = 0, []
    for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(~F.col("last")).alias("k")).orderBy("part").collect():
        sizes.append((r["part"], before))
        before += r["k"]
    first = F.broadcast(spark.createDataFrame(sizes, "part long, before long"))  # one row a range
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = ~F.col("last") & (rank <= percent * before // 100)
    return placed.join(first, "part").withColumn("rank", F.when(drawn, rank))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, head: int = HEAD) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score and, if it is drawn, rank.

    Of the N rows with min_words words or more, N * percent // 100 of the highest score are drawn; equal scores go to the smaller key,
    a null key first, equal keys in any order. A null or empty text has no features and weight 0. Repeated rows are rows of
    their own. Other columns are ignored, whatever their names. Without a target every bucket's gain falls as its
    count in docs grows; an empty table gives no rows.

    Texts are read twice, for the head and to be hashed; after that rows carry two bytes a feature, and in the sort numbers only. To
    the driver go the head and bucket totals, whose sizes are fixed, and one row for each range.
    """
    known = find_head(docs, text, max_n, head)
    named = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    source = stored(hashed(named, known, ["doc_id"], "text", max_n, buckets))
    goal = hashed(target.select(F.col(f"`{target_text}`").alias("text")), known, [], "text", max_n, buckets)
    gain = gains(bucket_totals(source, buckets), bucket_totals(goal, buckets))
    rows = weighed(source, gain, ["doc_id", "n_words", "n_features"])
    rows = rows.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("uid", F.xxhash64(F.monotonically_increasing_id()))
    return ranked(rows, percent, min_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn(spark: SparkSession, docs: DataFrame, report: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that resample() drew, with all their columns. Keys must be unique, or all rows of a drawn key come."""
    picked = report.filter("rank is not null").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(picked, docs[f"`{key}`"].cast("long").eqNullSafe(picked["_key"]), "left_semi")
