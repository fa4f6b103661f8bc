"""Quality rules, secret scans, line dedup, repeated strings: against brute force on odd texts."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import lines, quality, secrets, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "é ü\tx\u00a0y", "one two three " * 40, "# $ | <x>", "a b c\na b c\n\na b c", "x" * 5000, "w " * 3000]


def docs(spark, texts, extra="n_words string, Text_in string, found string"):
    return spark.createDataFrame([(i, t, "e", "t", None) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def base(t):
    w = WORD.findall(t or "")
    grams = collections.defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    held = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(held)


def test_quality_base_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c\n", "dé ", "#"]) for _ in range(rng.randrange(300))) for _ in range(40)]
    got = {r["doc_id"]: r for r in quality.quality_report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n = base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])


def test_quality_filter_keeps_columns_and_clean_rows(spark):
    rng = random.Random(4)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    df = docs(spark, [clean, "x y z " * 50, None, clean])
    out = quality.quality_filter(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 3]
    assert quality.quality_filter(df.filter("false")).count() == 0


ASSIGN = re.compile(secrets.ASSIGN, re.A)


def expected_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(out))


def test_secret_base_spans(spark):
    rng = random.Random(5)
    parts = ["password: token: abcdefghij", "Api_Key='", "AKIA", "ABCDEFGH0123", "deadbeef" * 4, " ", "é", "secret=", "==abcdefg", '"', "passwd", "TOKEN", ":", "x" * 9, "0" * 31, "𝒳"]
    texts = [None, "", "password" * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    for r in secrets.secret_report(docs(spark, texts)).collect():
        want = expected_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("random")) == want


def labelled():
    """(token, whether it is a secret): paths, slugs, identifiers and names of several kinds, keys of several encodings."""
    rng = random.Random(6)
    words = "internal docs release notes summary changes report data training batch window index service gateway update Customer Invoice Payment handler factory archive getting started release-candidate user profile settings".replace("-", " ").split()
    w = lambda n, sep, f=str: sep.join(f(rng.choice(words)) for _ in range(n))
    date = lambda sep: f"20{rng.randrange(10, 25)}{sep}{rng.randrange(1, 13):02}{sep}{rng.randrange(1, 29):02}"
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    plain = []
    for _ in range(40):
        plain += [
            f"https://blog.example.org/{date('/')}/{w(5, '-', str.lower)}", f"docs/{date('-')}_{w(2, '_')}/{w(2, '-')}", f"src/main/java/org/{w(3, '/', str.lower)}/{w(3, '', str.title)}Test2",
            f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", w(5, "", str.title) + "1", w(4, "_", str.upper) + f"_{rng.randrange(100)}", f"/var/log/{w(3, '-')}-{date('')}T120000Z", f"{w(4, '_', str.lower)}_v{rng.randrange(9)}_{date('')}",
        ]
    alphabets = {n: a for n, _, a in secrets.ENCODINGS}
    key = lambda name, n: "".join(rng.choice(alphabets[name]) for _ in range(n))
    keys = []
    for _ in range(30):
        keys += [key("base62", 40), key("base64", 44) + "==", key("base64url", 43), key("hex", 64).upper(), key("base32", 52), key("base62", 64), key("base64", 86) + "==", key("base62", 40).join(("sk_live_", "")), "xoxb-" + "".join(rng.choice("0123456789") for _ in range(12)) + "-" + "".join(rng.choice("0123456789") for _ in range(13)) + "-" + key("base62", 24)]
    return [(t, False) for t in plain] + [(t, True) for t in keys]


def test_battery_tells_keys_from_text(spark):
    rows = labelled()
    got = {r["doc_id"]: r["n_random"] for r in secrets.secret_report(docs(spark, [f"see {t} now" for t, _ in rows])).collect()}
    hits = sum(got[i] > 0 for i, (_, secret) in enumerate(rows) if secret)
    wrong = sum(got[i] > 0 for i, (_, secret) in enumerate(rows) if not secret)
    parted = [got[i] > 0 for i, (t, _) in enumerate(rows) if t.startswith(("xoxb-", "sk_live_"))]
    assert len(parted) == 60 and sum(parted) >= 54
    assert hits >= 0.9 * sum(s for _, s in rows) and hits >= 0.9 * (hits + wrong), (hits, wrong)
    tested = spark.createDataFrame([(t,) for t, _ in rows if "." not in t and ":" not in t], "t string").select(secrets.battery(F.col("t")).alias("r")).collect()
    assert all(x["r"]["encoding"] is not None and x["r"]["p"] is not None for x in tested)


def test_battery_equals_sql(spark, tmp_path):
    import duckdb

    from tessera.llm import oracles

    rng = random.Random(9)
    rows = labelled()
    rng.shuffle(rows)
    texts = [f"é {a} b secret={b} {c}/x password: {a}" for (a, _), (b, _), (c, _) in zip(rows[::3], rows[1::3], rows[2::3], strict=False)] + [None, "", "x" * 500]
    df = docs(spark, texts).select("doc_id", "text")
    df.write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = c.sql(oracles.OP4)
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(df).collect()}
    assert got == {r[0]: r[1] for r in want.project("doc_id, spans").fetchall()} and sum("random" in x for x in got.values()) > 50


def test_secret_scan_of_very_long_texts(spark):
    import time

    rng = random.Random(10)
    key = "".join(rng.choice(secrets.ENCODINGS[3][2]) for _ in range(1_000_000))
    many = " ".join(f"{i:08d}tokenOfSomeWordsAndMore" for i in range(100_000))
    fixed = " ".join(f"password=abcdefgh{i}" for i in range(100_000))
    texts = ["x" * 1_000_000, key, many, fixed, "password" + " " * 1_000_000]
    began = time.time()
    df = secrets.find_secrets(docs(spark, texts), out="hits")
    got = {r["doc_id"]: r for r in df.select("doc_id", F.size("hits").alias("n"), secrets.masked(F.coalesce("text", F.lit("")), F.col("hits")).alias("m")).collect()}
    assert time.time() - began < 120
    assert got[3]["n"] == 100_000 and got[3]["m"] == " ".join(["<assign>"] * 100_000)
    assert got[1]["m"] in (key, "<random>") and got[0]["m"] == texts[0] and got[2]["n"] == 0 and got[4]["n"] == 0


def test_secret_columns_may_clash(spark):
    df = docs(spark, ["secret=abcdefgh12"]).withColumn("C", F.lit(1)).withColumn("scan_out", F.lit(2)).withColumn("text_in", F.lit(3))
    out = secrets.find_secrets(df, out="c")
    assert out.columns == [x for x in df.columns if x != "C"] + ["c"] and out.first()["c"][0]["end"] == 17
    assert secrets.find_secrets(df.filter("false")).count() == 0


def test_masking(spark):
    df = secrets.find_secrets(docs(spark, ["é secret=abcdefgh12 z", "none", None]), out="hits")
    assert {r["doc_id"]: r["m"] for r in df.select("doc_id", secrets.masked(F.coalesce("text", F.lit("")), F.col("hits")).alias("m")).collect()} == {0: "é <assign> z", 1: "none", 2: ""}
    assert "found" in df.columns


def deduped(rows):
    seen, out = {}, []
    for k, (key, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        held = (t or "").split("\n")
        full = [i for i, x in enumerate(held) if x.strip(" ")]
        gone = set()
        for a in range(len(full) - 2):
            w = tuple(held[i].strip(" ") for i in full[a : a + 3])
            if seen.setdefault(w, (k, a)) != (k, a):
                gone |= set(range(full[a], full[a + 2] + 1))
        out.append((key, t if not gone else "\n".join(x for i, x in enumerate(held) if i not in gone), len(gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    pool = ["a", "b", " c ", "", "dd", "é"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)] + [(99, None), (98, ""), (None, "a\nb\ndd"), (97, "x\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cut", F.lit(1)).withColumn("own_text", F.lit("c")).withColumn("r_doc", F.lit(0))
    out = lines.dedup_lines(df, removed="n")
    assert out.columns == [*df.columns, "n"]
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n"]) for r in out.collect()))) == sorted(map(str, deduped(rows)))


def test_line_dedup_treats_repeated_rows_alike(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] * 2 + [(2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(df).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]
    assert lines.dedup_lines(df.filter("false")).count() == 0


def without_repeats(rows, n):
    seen = collections.Counter(b[i : i + n] for _, b in rows for i in range(len(b) - n + 1))
    out = []
    for key, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((key, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_passages_of_many_words_are_reported(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(51) for _ in range(8)]
    rows, want = [], {}

    def add(t, shares):
        want[len(rows)] = shares
        rows.append((len(rows), t))

    for k in range(40):
        add(" ".join(text(rng.randrange(90)) + passages[k % 8] + text(rng.randrange(90))), True)
    for k in range(20):  # too short a part of a passage, which isn't one
        add(" ".join(text(80) + passages[k % 8][:37] + text(80)), False)
    for _ in range(20):
        add(" ".join(text(rng.randrange(1, 300))), False)
    twice = " ".join(text(60))
    add(f"{twice} x {twice}", False)  # within one text alone
    long = " ".join(text(200))
    for t, shares in ((long, True), (long, True), (" ".join(passages[0]), True), (" ".join(text(50)), False), ("a b c " * 10, False), ("a b c " * 10, False), (None, False), ("", False), ("w" * 3000, False), ("w" * 3000, False)):
        add(t, shares)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["shares_passage"] for r in suffixes.remove_repeats(df).collect()} == want


def test_suffix_array_steps():
    """Over ranges of a sorted array, the first entry that shares d bytes, with what a range inherits, against all entries."""
    rng = random.Random(12)
    rows = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))).encode() for _ in range(120))
    cuts = [0, 1, 30, 31, 32, 90, 120]
    before, tail, steps = ([], []), b"", ([], [])
    for part, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        shared = int(suffixes.common_bytes([tail, rows[a]])[1])
        before = ([*steps[0]], [*steps[1]])
        suffixes.step(*before, shared, -1, 0)
        ids, depths, last = [], [], rows[a]
        for k in range(a, z):
            suffixes.step(ids, depths, int(suffixes.common_bytes([last, rows[k]])[1]) if k > a else 0, (part << 32) + k - a, len(rows[k]))
            last = rows[k]
            steps = suffixes.inherit(before, list(ids), list(depths), part << 32)
            for d in range(1, len(rows[k]) + 1):
                got = next(i for i, depth in zip(*steps, strict=True) if depth >= d)
                assert cuts[got >> 32] + (got & 0xFFFFFFFF) == next(i for i, x in enumerate(rows) if x[:d] == rows[k][:d])
        tail = last


@pytest.mark.parametrize("length", [400, 60])
def test_repeated_strings_equal_brute_force(spark, length, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", 4000)  # several ranges in each array
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno é") for _ in range(n))
    pool = [noise(2000) for _ in range(3)]
    rows = [(i, pool[i % 3][rng.randrange(300) : rng.randrange(500, 2000)] + noise(rng.randrange(200)) + pool[(i + 1) % 3][: rng.randrange(length - 10, length + 20)]) for i in range(12)]
    rows += [(100, "a" * 900), (101, "a" * 450), (102, "Is " * 300), (103, "xIs " * 150), (104, None), (105, ""), (106, pool[0]), (106, pool[0]), (107, "b" * length), (108, "c" * (length + 1))]
    for k in range(10):
        t = list(pool[2])
        t[rng.randrange(len(t))] = "#"
        rows.append((200 + k, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffixes.remove_repeats(df, length=length).drop("kept", "shares_passage").collect())
    assert got == without_repeats([(k, (t or "").encode()) for k, t in rows], length)
