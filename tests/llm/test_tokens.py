"""Tokenizers, record files, packing and chats: equality with the libraries, and exact round trips."""

import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import chat, packing, pieces, records, tokens

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.one_of(st.sampled_from("abcdeinorst  .,'!\n\tABéÉü0123-_"), st.characters(exclude_categories=["Cs"])), max_size=80)
ODD = [None, "", " ", "\n \n", "<|endoftext|> x<|startoftext|>", "it's they're. don'T,", "İI ß ΑΣ. ﬁ ǅ x² 漢字。", "a\x1cb\x85c", "word " * 9000]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_the_library_s(text):
    enc = tokens.encoder(WORDS)
    assert np.frombuffer(enc.encode(text), enc.kind).tolist() == enc.known.library.encode(text, add_special_tokens=False).ids


SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_shortest_paths_are_the_merges(text):
    t = pieces.transducer(PIECES)
    ids = array("I", t.encode(text))
    assert ids.tolist() == SP.encode(text) and t.decode(ids) == SP.decode(ids.tolist())


def test_pieces_query(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    for r in pieces.encode_decode(df, PIECES).collect():
        want = array("I", SP.encode(ODD[r["doc_id"]] or "")).tobytes()
        assert r["ids_crc32"] == zlib.crc32(want) and bytes(r["ids"]) == want and r["round_trip"]


def test_unigram_paths_have_least_weight():
    def field(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    import struct

    table = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -1.5, 1), ("ab", -0.1, 1), ("▁ab", -3.0, 1), ("▁", -0.5, 1), ("a", -2.0, 1)]
    model = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in table) + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1]))
    t = pieces.Transducer(model)
    assert [t.text[i] for i in array("I", t.encode("ab"))] == ["▁", "ab"]


def field(n, b):
    return bytes([n << 3 | 2]) + (bytes([len(b)]) if len(b) < 128 else bytes([len(b) & 127 | 128, len(b) >> 7 & 127 | 128, len(b) >> 14 & 127 | 128, len(b) >> 21])) + b


def unigram(normalizer: bytes) -> bytes:
    """A model of a few hundred scored pieces and bytes, none trained."""
    import random
    import struct

    rng = random.Random(13)
    table = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -4.0, 1)]
    names = {"▁▁", "fi", "x2", "▁a", "é"} | {rng.choice(["▁", ""]) + "".join(rng.choice("abcdeino123") for _ in range(rng.randrange(1, 5))) for _ in range(300)}
    table += [(p, -round(rng.uniform(1, 12), 3), 1) for p in sorted(names)]
    pieces_ = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in table)
    return pieces_ + field(2, bytes([3 << 3, 1, 35 << 3 & 127 | 128, 35 >> 4, 1])) + field(3, normalizer)


def _normalizers():
    """Character maps of the library's rules, and all ways to treat spaces without one."""
    out = [bytes([3 << 3, p, 4 << 3, c, 5 << 3, 1]) for p in (0, 1) for c in (0, 1)]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        charsmap = next(v for f, v in pieces._fields(next(v for f, v in pieces._fields(proto) if f == 3)) if f == 2)
        out.append(field(2, charsmap) + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1]))
    return out


MODELS = [(pieces.Transducer(m), sentencepiece.SentencePieceProcessor(model_proto=m)) for m in map(unigram, _normalizers())]
MAPPED = st.text(st.one_of(st.sampled_from("abcdeino123  ﬁ²①Aé\u0301\u3000\u00a0\u200b\t\n½㌔ｱﾞ"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(MAPPED, st.sampled_from(range(6)))
def test_unigram_models_equal_the_library(text, which):
    ours, library = MODELS[which]
    got, want = array("I", ours.encode(text)).tolist(), library.encode(text)
    if got != want:  # of paths of equal weight either may win
        weigh = lambda ids: sum(ours.weight[i] if not ours.is_byte[i] else 0 for i in ids)
        assert abs(weigh(got) - weigh(want)) < 1e-3 and ours.decode(array("I", got)) == ours.decode(array("I", want))


def test_caches_are_bounded():
    kept = pieces.Kept(str.encode, 2000)
    for k in range(100):
        assert kept[f"{k}"] == b"%d" % k and kept["x" * 5000] == b"x" * 5000
    assert len(kept) <= 10 and len(kept.old) <= 10 and not any(len(k) > kept.LONGEST for k in kept)
    enc = tokens.encoder(WORDS)
    before = len(enc.known)
    enc.encode("漢" * 5000)
    assert len(enc.known) == before


def test_records_round_trip(spark, tmp_path):
    rows = [(9 - i, t) for i, t in enumerate(ODD)] + [(None, "null key"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/r"
    records.write_records(df, path, WORDS)
    got = sorted(records.read_digests(spark, path).collect(), key=lambda r: r["start"])
    lib = Tokenizer.from_file(WORDS)
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at, want = 0, {}
    for k, t in rows:
        want.setdefault(k, []).append(zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
    for r in got:
        assert r["start"] == at and r["ids_crc32"] in want[r["doc_id"]]
        at += r["n_tokens"]
    records.write_records(df.filter("false"), f"file://{tmp_path}/none", WORDS)
    assert records.read_digests(spark, f"file://{tmp_path}/none").count() == 0


def test_damage_is_found():
    data = bytearray(records.frame(b"payload") + records.frame(b"next"))
    assert records.unframe(bytes(data)) == (b"payload", 23)
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            _, nxt = records.unframe(bytes(bad))
            records.unframe(bytes(bad), nxt)


def test_curve_visits_neighbours():
    places = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    cells = sorted(zip(packing.hilbert_key(np.array(places), 3).tolist(), places, strict=True))
    assert [k for k, _ in cells] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(cells, cells[1:], strict=False))


@pytest.mark.parametrize(("ranges", "together"), [(None, 1024), (50, 1024), (50, 8), (1, 1)])
def test_packing_holds_each_id_once(spark, monkeypatch, ranges, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, "some text here " * (i * 37 % 400)) for i in range(40)] + [(None, "x"), (3, "again")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, curve_key string, ids string, range string")
    got = packing.pack(df, WORDS, ranges=ranges).collect()
    lib = Tokenizer.from_file(WORDS)
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == total
    seqs = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs.get(r["sequence_id"], 0)
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in seqs.values())
    groups = 1 if together == 1024 else -(-50 // together) if ranges == 50 else 1
    assert sum(n < 4096 for n in seqs.values()) <= 12 * groups
    ids = {}
    for k, t in rows:
        ids.setdefault(k, []).append(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    for k, held in ids.items():
        own = [r for r in got if r["doc_id"] == k]
        assert sorted((r["doc_tokens"], i) for r in own for i in range(r["start"], r["start"] + r["length"])) == sorted((len(x), i) for x in held for i in range(len(x)))
        for r in own:
            assert r["ids_crc32"] in {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in held if len(x) == r["doc_tokens"]}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("user:#\\ "), max_size=6), st.text(st.sampled_from("\\#</turn> \n:a"), max_size=30)), max_size=5))
def test_rendered_chats_parse_back(turns):
    text, spans = chat.render([*turns, ("assistant", "### x")])
    assert chat.parse(text) == [*turns, ("assistant", "### x")]
    assert chat.unescape(text[spans[-1]["start"] : spans[-1]["end"]]) == "### x"


def test_log_folds_to_final_messages(spark):
    log = [
        (1, 0, None, "message", "user", "hi"), (1, 1, None, "message", "assistant", ""), (1, 2, 1, "delta", None, "wro"), (1, 3, 1, "delta", None, "ng"),
        (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "right"), (1, 6, 0, "edit", None, "hello"), (1, 7, None, "message", "user", "x"), (1, 8, 7, "delete", None, None),
        (2, 5, 9, "delta", None, "late"), (None, 0, None, "message", None, None), (3, 0, None, "odd", "user", "?"), (4, 0, None, "message", "user", "a"), (4, 0, None, "message", "user", "a"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, target long, event string, role string, text string")
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_chats(df).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "right")], 2: [("assistant", "late")], None: [("", "")], 3: [], 4: [("user", "a")] * 2}
    lone = [(None, i, i % 3, "delta", None, str(i)) for i in range(6)]
    assert sorted(r["formatted"] for r in chat.format_chats(spark.createDataFrame(lone, df.schema)).collect()) == [f"### assistant: {i}{i + 3} </turn>\n" for i in range(3)]
    assert chat.format_chats(df.filter("false")).count() == 0


def test_derived_log_needs_folding(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} é " * (t * 97 % 130)) for c in range(40) for t in range(7)]
    rows += [(50, 0, "user", "same")] * 2 + [(51, None, None, None), (52, 1, "assistant", "b"), (52, 1, "assistant", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    log = chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r["event"]: r["n"] for r in log.groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == set(chat.EVENTS) and kinds["message"] > len(rows)
    assert log.filter("event = 'message' and text is not null and text not like 'draft%'").count() == 0
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)):
        want.setdefault(c if c is not None else text, []).append((role or "", text or ""))
    got = chat.format_chats(log.orderBy(F.xxhash64("seq", "target"))).collect()
    assert len(got) == len(want)
    for r in got:
        turns = chat.parse(r["formatted"])
        assert turns == want[r["conv_id"] if r["conv_id"] is not None else turns[0][1]]
    # without the fold, by taking all texts in order, the messages come out otherwise
    plain = log.orderBy("seq").filter("conv_id < 40").groupBy("conv_id").agg(F.concat_ws("", F.collect_list("text")).alias("t"))
    assert any(r["t"] != "".join(t for _, t in want[r["conv_id"]]) for r in plain.collect())
    assert chat.format_chats(chat.log_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_planted_conversation(spark):
    r = chat.chat_digests(chat.format_chats(chat.log_of(chat.planted(spark)))).first()
    assert (r["n_turns"], r["loss_chars"]) == (2, len("\\### Assistant: </turn> ok"))


def test_bytes_that_are_no_text(spark, tmp_path):
    """Bytes that aren't UTF-8 are U+FFFD to the tokenizers."""
    bad = spark.sql("select 1L doc_id, cast(X'61ff4162fe20c3' as string) text, 'a' ids, 'b' n_ids, 'c' round_trip union all select 2L, 'plain', 'a', 'b', 'c' union all select 2L, 'plain', 'a', 'b', 'c'")
    shown = b"a\xffAb\xfe \xc3".decode("utf-8", "replace")
    lib = Tokenizer.from_file(WORDS)
    want = lambda t, end: zlib.crc32(np.array(lib.encode(t, add_special_tokens=False).ids + [end], "<u4").tobytes())
    records.write_records(bad, f"file://{tmp_path}/r", WORDS)
    got = records.read_digests(spark, f"file://{tmp_path}/r").collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got) == [(1, want(shown, 1)), (2, want("plain", 1)), (2, want("plain", 1))]
    packed = packing.pack(bad, WORDS).filter("doc_id = 1 and length = doc_tokens").collect()
    assert not packed or packed[0]["ids_crc32"] == want(shown, 2)
    encoded = {r["doc_id"]: r for r in pieces.encode_decode(bad, PIECES).collect()}
    assert encoded[1]["round_trip"] and pieces.encode_decode(bad, PIECES).count() == 3
    assert pieces.encode_decode(bad.filter("false"), PIECES).collect() == []


def test_rows_of_one_key_are_in_several_files(spark, tmp_path):
    rows = [(None, "same text")] * 400 + [(7, f"text {i}") for i in range(400)] + [(i, "other") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small ranges share a file
    files = records.write_records(df, f"file://{tmp_path}/r", WORDS)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 2 and max(f["n_records"] for f in files) < 500
    got = sorted(records.read_digests(spark, f"file://{tmp_path}/r").collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert len(keys) == 900 and keys == sorted(keys, key=lambda k: (k is not None, k or 0))
