"""Removal of repeated byte strings by prefix-free parsing.

A text is cut into phrases at triggers: places whose next TRIGGER bytes have a rolling hash in a fixed set, so that equal
strings are cut alike wherever they stand. The corpus becomes a dictionary of distinct phrases and, per text, a parse. A
string of LENGTH bytes is the end of the phrase before its first trigger, then the phrases of the parse from there on, cut off
at LENGTH; two places hold the same string just where these agree. Most strings need no order to be told apart:

1. A phrase that occurs once rules out every string that contains it.
2. The strings left that share their first trigger are a class, led by what all of them hold from that trigger on. A class
   whose bytes, from its first string to the end of its last, occur twice, repeats as a whole.

3. Where one lead begins several classes, one of each kind goes into two suffix arrays. That of the parse has the texts from the triggers
   on, to depth LENGTH, in byte order; that of the dictionary has the phrases before the triggers, from the back, so that
   the phrases with a common end are neighbours. Both are sorted by ranges, and the common bytes of neighbours give, for each
   depth, the first entry that shares so many bytes. A string a bytes before its trigger is then known by two numbers: the
   first phrase with the same last a bytes and the first text with the same next LENGTH - a; in the order of both, which is
   the order of the corpus, equal strings are neighbours.
4. Strings without a trigger near, inside a long phrase, are compared as they are, once per content of a text.

Passages that are long in words but shorter than LENGTH bytes are not removed. They are reported: the parse also tells which
windows of words hold no phrase that occurs once, and of these one in PASSAGE words in a row, the one of the least hash, is looked up.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch_dir, stored
from .hashing import BASE, BYTE, mix, powers, prefix, spans_hash, word_spans

LENGTH = 400
#: Bytes of a trigger, and the mean distance of triggers.
TRIGGER, SPACING = 16, 48
#: Bytes before the first trigger up to which strings are told apart by what follows the trigger, not by its phrase alone.
REACH = 80
#: Mean distance of dense triggers, which lead strings that hold no whole phrase.
DENSE = 6
#: Words of a passage that is reported wherever it stands in two texts, and of the windows by which it is found.
PASSAGE, WORDS = 51, 38
_U = np.uint64
_OTHER = mix(BYTE ^ BASE)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean, kept binary"


def triggers(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the triggers, and of the dense ones, a set that holds them, from a text's prefix sums."""
    n = len(p) - 1
    if n < TRIGGER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - TRIGGER + 1)
    h = spans_hash(p, at, at + TRIGGER) >> _U(32)
    dense = np.flatnonzero(h * _U(DENSE) >> _U(32) == 0)
    return dense[h[dense] * _U(SPACING) >> _U(32) == 0], dense


def phrases(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Hashes of the phrases, each from a trigger to the end of the next."""
    return spans_hash(p, t[:-1], t[1:] + TRIGGER) if len(t) > 1 else np.zeros(0, _U)


def second_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums over other numbers per byte than prefix() has; spans_hash() takes either."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_OTHER[data] * powers(BASE, len(data)), out=out[1:])
    return out


def candidates(n: int, t: np.ndarray, dense: np.ndarray, once: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first, last, begin, end) of starts of strings that hold no phrase marked in once.

    All strings of a run hold the bytes [begin, end), their lead, at the same place of the text, and equal strings
    have equal leads: length - REACH bytes from the first trigger where that is within REACH of the start, else the
    phrase that begins there where the string holds the whole of it, else length - REACH bytes from the first dense
    trigger within REACH, else none, where begin and end are 0.
    """
    size = n - length + 1
    none = np.zeros(0, np.int64)
    if size <= 0:
        return none, none, none, none
    step = np.zeros(size + 1, np.int64)
    if len(once) and once.any():
        a = np.maximum(t[1:][once] + TRIGGER - length, 0)
        z = np.minimum(t[:-1][once] + 1, size)
        np.add.at(step, a[a < z], 1)
        np.add.at(step, z[a < z], -1)
    s = np.flatnonzero(np.cumsum(step[:size]) == 0)
    if not len(s):
        return none, none, none, none
    reach = min(REACH, length - TRIGGER)
    far = n + 2 * length
    first = np.searchsorted(t, s)
    begin = np.append(t, far)[first]
    end = np.append(t, [far] * 2)[first + 1] + TRIGGER
    near, whole = begin - s <= reach, end <= s + length
    other = np.append(dense, far)[np.searchsorted(dense, s)]
    dense_near = other - s <= reach
    end = np.where(near, begin + length - reach, np.where(whole, end, np.where(dense_near, other + length - reach, 0)))
    begin = np.where(near | whole, begin, np.where(dense_near, other, 0))
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(s) > 1) | (np.diff(begin) != 0) | (np.diff(end) != 0))))
    return s[cut], s[np.append(cut[1:], len(s)) - 1], begin[cut], end[cut]


def passage_windows(data: np.ndarray, p: np.ndarray, t: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Hashes of windows of WORDS words, at least one out of each PASSAGE words in a row that hold no phrase marked in once."""
    start, end = word_spans(data)
    reach = PASSAGE - WORDS + 1
    n = len(start) - WORDS + 1
    if n < reach:
        return np.zeros(0, np.int64)
    first, last = start[:n], end[WORDS - 1 :]
    held = np.searchsorted(t[1:][once] + TRIGGER, last, "right") > np.searchsorted(t[:-1][once], first)
    free = np.concatenate(([0], np.cumsum(held)))
    runs = np.flatnonzero(free[reach:] == free[:-reach])  # PASSAGE words from here on hold none
    if not len(runs):
        return np.zeros(0, np.int64)
    words = spans_hash(p, start, end)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    at = np.arange(n)
    h = spans_hash(sums, at, at + WORDS)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, reach)[runs].min(1)).view(np.int64)


def _view(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8)


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield _view(x.as_py() or b"")


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(zip(*columns, strict=True) if columns else [()] * len(schema), schema, strict=True)], schema=schema)


#: Bytes of text in a bucket of the text table, bytes of a range of a suffix array, and rows of a phrase, as a share of all, from which it
#: isn't joined by hash.
BUCKET, RANGE, HOT_SHARE = 256 << 20, 16 << 20, 1000


def _text_table(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """(rid, doc_id, body) of each row, bucketed by rid in the shared folder, and the table's name: later joins by rid never move the texts again."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body"))
    size = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    name = f"tessera_{uuid.uuid4().hex}"
    out = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "body").repartition(n, "rid").sortWithinPartitions("rid").write.bucketBy(n, "rid").sortBy("rid")
    out.option("compression", "zstd").option("path", scratch_dir(spark)).saveAsTable(name)
    return spark.table(name), name


_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("weight", pa.int32()), ("rid", pa.int64()), ("at", pa.int64())])
_FOUND = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("lead", pa.int64()), ("body1", pa.int64()), ("body2", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("reach", pa.int32()), ("weight", pa.int32())])
#: Kinds of runs as they go through the suffix arrays, and the columns that an array adds.
_KIND = [("rid", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]
_ARRAY = [("ids", pa.list_(pa.int64())), ("depths", pa.list_(pa.int32()))]
#: Kinds of what a text is found to hold: runs of strings with a lead, runs that repeat within the text, single strings, windows of words.
RUN, OWN, SINGLE, WINDOW = 0, 1, 2, 3


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def common_bytes(rows: list[bytes]) -> np.ndarray:
    """How many bytes each of rows shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) < 2:
        return out
    length = np.array([len(x) for x in rows])
    wide = int(length.max()) + 1
    ends = np.cumsum(length)
    x = np.zeros((len(rows), wide), np.int16)
    x[np.repeat(np.arange(len(rows)), length), np.arange(ends[-1]) - np.repeat(ends - length, length)] = np.frombuffer(b"".join(rows), np.uint8)
    x[np.arange(wide) >= length[:, None]] = -1
    differ = x[1:] != x[:-1]
    differ[:, -1] = True
    out[1:] = np.minimum(differ.argmax(1), np.minimum(length[1:], length[:-1]))
    return out


def step(ids: list[int], depths: list[int], shared: int, own: int, size: int) -> None:
    """Takes the next row of a sorted array into (ids, depths): for a depth d, the first id whose depth is d or more is the
    first row that shares d bytes with the newest. shared is what the newest shares with the one before it, size its length."""
    first = None
    while depths and depths[-1] > shared:
        first = ids.pop()
        depths.pop()
    if first is not None and shared > (depths[-1] if depths else 0):
        ids.append(first)
        depths.append(shared)
    if size > (depths[-1] if depths else 0):
        ids.append(own)
        depths.append(size)


def inherit(before: tuple[list[int], list[int]], ids: list[int], depths: list[int], first: int) -> tuple[list[int], list[int]]:
    """A row's (ids, depths) with its part's first row, id first, traced on to the rows before that part."""
    if not before[0] or not ids or ids[0] != first:
        return ids, depths
    out: tuple[list[int], list[int]] = ([], [])
    for i, d in [*((i, min(d, depths[0])) for i, d in zip(*before, strict=True)), *zip(ids, depths, strict=True)]:
        if d > (out[1][-1] if out[1] else 0):
            out[0].append(i)
            out[1].append(d)
    return out


def suffix_array(rows: DataFrame, column: str, kept: list[tuple]) -> tuple[DataFrame, dict[int, tuple[list[int], list[int]]]]:
    """The kept columns of rows (rid, first, ..., column) with ids and depths as step() gives them in the byte order of the column.

    The order is cut into ranges of (column, rid, first), so that a common content is split too. Each range starts afresh;
    what its first row inherits from the ranges before comes apart, by range, for inherit(). It is worked out from one row
    of each range. The driver holds these and Spark's sample for the ranges, some 300 rows of each and three millions at most.
    """
    out_schema = pa.schema([*kept, *_ARRAY, ("edge", pa.int32()), ("head", pa.binary()), ("tail", pa.binary())])
    at = [f.split(" ")[0] for f in rows.columns].index(column)
    places = [rows.columns.index(n) for n, _ in kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n, head, last = part << 32, None, None
        ids: list[int] = []
        depths: list[int] = []
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                content = batch.column(at).to_pylist()
                if head is None:
                    head = last = content[0]
                shared = common_bytes([last, *content])[1:].tolist()
                held = []
                for text, common in zip(content, shared, strict=True):
                    step(ids, depths, common if n & 0xFFFFFFFF else 0, n, len(text))
                    held.append((list(ids), list(depths)))
                    n += 1
                last = content[-1]
                none = [pa.nulls(len(content), f.type) for f in list(out_schema)[-3:]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array([x for x, _ in held], _ARRAY[0][1]), pa.array([x for _, x in held], _ARRAY[1][1]), *none], schema=out_schema)
        if head is not None:
            values = [*(None for _ in kept), list(ids), list(depths), part, head, last]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out_schema, strict=True)], schema=out_schema)

    order = [column, "rid", "first"]
    ranges = -(-(rows.agg(F.sum(F.length(column) + 64)).first()[0] or 1) // RANGE)
    done = stored(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(scan, _ddl(out_schema)))
    release(rows.sparkSession)
    before, tail, steps = {}, b"", ([], [])
    for r in sorted(done.filter("edge is not null").select("edge", "head", "tail", "ids", "depths").collect(), key=lambda r: r["edge"]):
        shared = int(common_bytes([tail, bytes(r["head"])])[1])
        cut: tuple[list[int], list[int]] = (list(steps[0]), list(steps[1]))
        step(*cut, shared, -1, 0)
        before[r["edge"]] = cut
        steps, tail = inherit(cut, r["ids"], r["depths"], r["edge"] << 32), bytes(r["tail"])
    return done.filter("edge is null").drop("edge", "head", "tail"), {k: v for k, v in before.items() if v[0]}


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from first to last of each run."""
    many = last - first + 1
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def _roles(table: DataFrame, length: int) -> DataFrame:
    """(rid, weight) of texts that have copies: 2 for the first of them, which stands for all, 0 for the others.

    Texts with more copies than a HOT_SHARE of all rows, HOT_SHARE texts at most, are broadcast; the others are joined by digest.
    """
    own = stored(table.filter(F.length("body") >= length).select("rid", F.md5("body").alias("digest")))
    copies = stored(own.groupBy("digest").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    hot = F.col("n") * HOT_SHARE > own.count()
    often = F.broadcast(copies.filter(hot))
    held = own.join(often.select("digest"), "digest", "left_anti").join(copies.filter(~hot).hint("merge"), "digest").unionByName(own.join(often, "digest"))
    return stored(held.select("rid", F.when(F.col("rid") == F.col("first"), 2).otherwise(0).alias("weight")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of docs RESULT: the text's bytes without those in a string of length bytes that starts anywhere else too.

    Texts are UTF-8 bytes, null is empty; strings never cross texts, overlaps count, and all is judged on the input. Texts
    shorter than length stay whole. Repeated rows are texts of their own, so each repeats the other. kept are the bytes left,
    which need not be whole characters. shares_passage is true for every text that has PASSAGE words in a row in common with another,
    however many bytes these have, and for none that has fewer than WORDS (up to collisions of 64 bits). Other columns are ignored; an empty
    table gives none.

    Copies of a text repeat as a whole; one of them, of weight 2, stands for all in what follows. Phrases are counted with
    partial aggregation, once per text that holds them; those of more than a HOT_SHARE of all such rows, HOT_SHARE at most, go
    round the join by a list. What is gathered per text is bounded by its length. Steps are written to the shared folder,
    and the shuffles before a written step are released.

    Texts count as copies by md5, runs as equal by 64 bits of a hash of each of two families over all their bytes, and so do strings without
    a trigger near; all other strings are compared byte by byte.
    """
    spark = docs.sparkSession
    table, name = _text_table(docs, key, text)
    roles = _roles(table, length)
    least = min(length, 2 * PASSAGE - 1)  # bytes of a text that may hold anything of note
    texts = table.join(roles, "rid", "left").withColumn("weight", F.coalesce("weight", F.lit(1))).filter("weight > 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text its distinct phrases, in order of their hashes, with how often it has them, 2 at most."""
        for batch in batches:
            out, many = [], []
            for data in _bytes(batch.column(2)):
                p = prefix(data) if len(data) >= least else np.zeros(1, _U)
                h, n = np.unique(phrases(p, triggers(p)[0]).view(np.int64), return_counts=True)
                out.append(h)
                many.append(np.minimum(n, 2).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(many, pa.binary())], names=["rid", "weight", "h", "many"])

    parsed = stored(texts.select("rid", "weight", "body").mapInArrow(cut, "rid long, weight int, h array<long>, many binary"))
    release(spark)
    places = parsed.select("rid", F.posexplode("h").alias("i", "h"), "weight", "many").select("rid", "i", "h", (F.col("weight") * F.when(F.substring("many", F.col("i") + 1, F.lit(1)) == F.lit(b"\1"), 1).otherwise(2)).alias("n"))
    counted = stored(places.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1"))
    total = parsed.agg(F.sum(F.size("h"))).first()[0] or 0
    hot = [r["h"] for r in counted.filter(F.col("rows") * HOT_SHARE > total).select("h").collect()]  # at most HOT_SHARE
    common = F.col("h").isin(hot) if hot else F.lit(False)
    again = places.filter(~common).join(counted.filter(~common).select("h").hint("merge"), "h").select("rid", "i").unionByName(places.filter(common).select("rid", "i"))
    again = stored(again.groupBy("rid").agg(F.collect_list("i").alias("again")))
    release(spark)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, weight, data, repeated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3), strict=True):
                n = len(data)
                if n < least:
                    continue
                p = prefix(data)
                t, dense = triggers(p)
                known, inverse = np.unique(phrases(p, t).view(np.int64), return_inverse=True)
                once = np.ones(len(known), bool)
                if repeated.is_valid:
                    once[repeated.values.to_numpy()] = False
                first, last, begin, end = candidates(n, t, dense, once[inverse], length)
                seen = passage_windows(data, p, t, once[inverse])
                row = lambda kind, lead, one, two, a, z, reach, w: (np.full(len(a), kind, np.int32), np.full(len(a), rid), lead, one, two, a, z, reach.astype(np.int32), w)  # noqa: B023, E731
                if len(seen):
                    zero = np.zeros(len(seen), np.int64)
                    out.append(row(WINDOW, seen, zero, zero, zero, zero, zero, np.full(len(seen), weight, np.int32)))
                if not len(first):
                    continue
                q = second_prefix(data)
                led = end > 0
                a, z, b = first[led], last[led], begin[led]
                one, two = (spans_hash(x, a, z + length).view(np.int64) for x in (p, q))
                out.append(row(RUN, spans_hash(p, b, end[led]).view(np.int64), one, two, a, z, b - a, np.full(len(a), weight, np.int32)))
                if not led.all():  # strings without a lead: once per content of this text
                    s = _spread(first[~led], last[~led])
                    w1, w2 = spans_hash(p, s, s + length).view(np.int64), spans_hash(q, s, s + length).view(np.int64)
                    _, at, back, count = np.unique(w1 ^ (w2 << 1), return_index=True, return_inverse=True, return_counts=True)
                    own = s[count[back] > 1]
                    if len(own):
                        edge = np.flatnonzero(np.concatenate(([True], np.diff(own) > 1)))
                        lo, hi = own[edge], own[np.append(edge[1:], len(own)) - 1]
                        out.append(row(OWN, lo, lo, lo, lo, hi, lo - lo, np.ones(len(lo), np.int32)))
                    out.append(row(SINGLE, w1[at], w1[at], w2[at], s[at], s[at], at - at, np.minimum(count * weight, 2).astype(np.int32)))
            yield _batch(out, _FOUND)

    held = texts.join(again, "rid", "left").select("rid", "weight", "body", "again")
    found = stored(held.mapInArrow(classes, _ddl(_FOUND)))
    release(spark)
    runs = found.filter(F.col("kind") == RUN).drop("kind")
    kinds = stored(runs.groupBy("lead", "body1", "body2").agg(F.sum("weight").alias("n")))
    several = kinds.groupBy("lead").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    known = kinds.join(several.hint("merge"), "lead", "left").filter("n > 1 or kinds is not null")
    # runs that repeat as a whole, and those under a lead of several kinds; the others hold no repeated string
    open_runs = stored(runs.join(known.hint("merge"), ["lead", "body1", "body2"]))
    release(spark)
    # one run of each kind goes into the suffix arrays
    one = open_runs.filter("kinds is not null").groupBy("lead", "body1", "body2").agg(F.min(F.struct("rid", "first", "last", "reach")).alias("one"), F.min("n").alias("n"))
    ask = one.select("one.rid", F.struct("one.first", "one.last", "one.reach", F.least("n", F.lit(2)).cast("int").alias("n")).alias("run"))
    ask = ask.groupBy("rid").agg(F.collect_list("run").alias("runs"))
    shown_schema = pa.schema([*_KIND, ("left", pa.binary()), ("right", pa.binary())])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run the bytes before its trigger, from the back, and those from it on."""
        for batch in batches:
            rows = []
            for rid, data, own in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for r in own:
                    a, z = r["first"], r["last"]
                    begin = a + r["reach"]
                    rows.append((rid, a, r["n"], begin - z, begin - a, data[a:begin][::-1].tobytes(), data[begin : z + length].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(shown_schema), shown_schema, strict=True)], schema=shown_schema)

    shown = stored(table.join(ask, "rid").select("rid", "body", "runs").mapInArrow(show, _ddl(shown_schema)))
    release(spark)
    dictionary, before_ends = suffix_array(shown, "left", [*_KIND, ("right", pa.binary())])
    dictionary = dictionary.withColumnsRenamed({"ids": "end_ids", "depths": "end_depths"})
    parse, before_texts = suffix_array(dictionary, "right", [*_KIND, ("end_ids", _ARRAY[0][1]), ("end_depths", _ARRAY[1][1])])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each string of the runs as the pair of first entries that share its two parts."""
        none: tuple[list[int], list[int]] = ([], [])

        def entries(before: dict, ids: list[int], depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
            part = ids[0] >> 32 if ids else 0
            i, d = inherit(before.get(part, none), ids, depths, part << 32)
            return np.array([*i, -1]), np.array([*d, 1 << 30])

        for batch in batches:
            out = []
            for rid, first, n, low, high, end_ids, end_depths, ids, depths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.arange(low, high + 1)
                ends, text = entries(before_ends, end_ids, end_depths), entries(before_texts, ids, depths)
                w1 = np.where(a > 0, ends[0][np.searchsorted(ends[1], a)], -1) * (length + 1) + a
                out.append((w1, text[0][np.searchsorted(text[1], length - a)], np.full(len(a), n, np.int32), np.full(len(a), rid), first + high - a))
            yield _batch(out, _WINDOWS)

    ordered = parse.select(*[n for n, _ in _KIND], "end_ids", "end_depths", "ids", "depths").mapInArrow(strings, _ddl(_WINDOWS)).withColumn("led", F.lit(True))
    alone = found.filter(F.col("kind") == SINGLE).select(F.col("body1").alias("w1"), F.col("body2").alias("w2"), "weight", "rid", F.col("first").alias("at"), F.lit(False).alias("led"))
    single = stored(ordered.unionByName(alone))
    release(spark)
    twice = single.groupBy("led", "w1", "w2").agg(F.sum("weight").alias("n")).filter("n > 1").drop("n")

    span = lambda a, z: F.struct(F.col(a).alias("first"), F.col(z).alias("last")).alias("span")
    hit = open_runs.filter("n > 1 and weight = 1").select("rid", span("first", "last"))
    hit = hit.unionByName(found.filter(F.col("kind") == OWN).select("rid", span("first", "last")))
    hit = hit.unionByName(single.filter("weight = 1").join(twice.hint("merge"), ["led", "w1", "w2"]).select("rid", span("at", "at")))
    windows = found.filter(F.col("kind") == WINDOW).select("rid", "lead", "weight")
    shared = windows.groupBy("lead").agg(F.min("rid").alias("one"), F.max("rid").alias("other"), F.max("weight").alias("most")).filter("one < other or most > 1").select("lead")
    sharing = stored(windows.join(shared.hint("merge"), "lead").select("rid").distinct())
    spans = stored(hit.groupBy("rid").agg(F.collect_list("span").alias("spans")))
    release(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data, own, copied, shares in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n, removed, pieces, kept = len(data), 0, 0, data
                if copied:
                    removed, pieces, kept = n, 1, data[:0]
                    shares = len(word_spans(data)[0]) >= PASSAGE
                elif own.is_valid:
                    a, z = (x.to_numpy() for x in own.values.flatten())
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, z + length, -1)
                    gone = np.cumsum(step[:n]) > 0
                    removed, pieces, kept = int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum()), data[~gone]
                kept = kept.tobytes()
                rows.append((doc, n, removed, pieces, hashlib.sha256(kept).hexdigest(), bool(shares), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in RESULT.split(", ")])

    done = table.join(spans, "rid", "left").join(roles.select("rid", F.lit(True).alias("copied")), "rid", "left").join(sharing.withColumn("shares", F.lit(True)), "rid", "left")
    out = done.select("doc_id", "body", "spans", "copied", "shares").mapInArrow(finish, RESULT)
    spark.sql(f"drop table {name}")  # the files stay for the result
    return out
