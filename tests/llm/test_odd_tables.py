"""Empty tables, clashing columns and very long texts, where the operators' own tests don't have them."""

import hashlib

from pyspark.sql import functions as F

from tessera.llm import chat, lines, suffixes, vectors


def test_repeated_strings_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(none).collect() == []
    long = " ".join(f"word{i}" for i in range(60_000))  # half a million characters, no string twice
    rows = [(1, long, 5, "a"), (2, "short", 6, "b"), (3, long[1000:2000] + " end", 7, "c"), (None, None, 8, "d")]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, rid string")).collect()}
    assert got[1]["n_removed"] == 1000 and got[1]["n_spans"] == 1 and got[1]["n_bytes"] == len(long)
    assert got[3]["n_removed"] == 1000 and got[2]["n_removed"] == 0 and got[None]["n_bytes"] == 0
    assert got[1]["kept_sha256"] == hashlib.sha256((long[:1000] + long[2000:]).encode()).hexdigest()


def test_lines_of_a_very_long_text(spark):
    body = [f"line {i}" for i in range(30_000)]
    rows = [(1, "\n".join(body), "x"), (2, "\n".join(["new", *body[100:110], "last"]), "y")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed string"), removed="gone").collect()}
    assert got[1]["gone"] == 0 and got[1]["text"] == rows[0][1] and got[2]["text"] == "new\nlast" and got[2]["n_removed"] == "y"


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], "a", "b"), (2, [1.0, 0.01], "a", "b"), (3, None, "a", "b"), (4, [0.0, 1.0], "a", "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
    assert vectors.near_vectors(df.filter("false")).collect() == []


def test_chats_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", "a", 9), (1, 1, "assistant", "there", "b", 8)], "conv_id long, turn int, role string, text string, kind string, seq int")
    plain = rows.select("conv_id", "turn", "role", "text")
    digests = lambda df: [tuple(r) for r in chat.chat_digests(chat.format_chats(chat.log_of(df))).collect()]
    assert digests(rows) == digests(plain) and len(digests(plain)) == 1
    assert digests(plain.filter(F.lit(False))) == []
