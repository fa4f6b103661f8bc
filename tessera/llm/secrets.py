"""Secret scans in column expressions: fixed patterns with positions, and a randomness test battery.

No Python runs on the executors. Positions come from split(): the pieces between the matches of a pattern and the matches
themselves alternate, so running sums of their lengths are the code-point offsets. Running sums go block by block and
texts are cut by way of chunks, so that the work on a text grows with its length, however many matches it holds.

The battery asks two things of a token of the alphabet of its encoding. Is it like noise: chi-squared uniformity over the alphabet, runs of
digits, small and capital letters, and serial correlation must all allow it. Is it unlike text: the same counts of repeated
signs and of runs are held against those of words, names and paths, and the chance that text looks so random is the
token's p. Benjamini-Hochberg over these p, per length band, picks what is reported, so that it is the share of text among the
reported tokens that is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, stored

# The patterns of the contract. A run of 32 or more of [0-9a-f] is the same match as a run of any length
# that is dropped below 32, and likewise for access; only assign needs its failing matches, as they use up text.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the battery looks at, with the least length at which it can tell text from noise.
TOKEN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
#: Short words or numbers, each with a separator, before a key of letters and digits, as in segmented keys: the key alone is tested.
HEADED = "^(?:(?:[A-Za-z]{1,8}|[0-9]{1,16})[_-])+([0-9A-Za-z]{20,})$"
#: Encodings by size of alphabet, as (name, pattern, alphabet); the first that fits is inferred.
ENCODINGS = (
    ("hex", "^[0-9a-fA-F]+$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    # TOKEN admits the signs of both base64 alphabets at once, as in dated paths; such a token is held against all 66 signs
    ("base64union", "^[0-9A-Za-z+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Encodings in which case doesn't count, or one case is all there is.
FOLDED = ("hex", "base36")


def _noise_switch(alphabet: str) -> float:
    """The chance that two letters or digits drawn evenly are of unlike class."""
    n = [sum(map(f, alphabet)) for f in (str.isdigit, str.islower, str.isupper)]
    return 1 - sum(x * x for x in n) / sum(n) ** 2


#: Of each encoding: how often the class switches from one letter or digit to the next in noise and, at most, in text.
NOISE_SWITCH = tuple(_noise_switch(x) for _, _, x in ENCODINGS)
TEXT_SWITCH = tuple(0.25 if len(x) > 36 else 0.15 for _, _, x in ENCODINGS)
#: The chance that two signs of a text are equal, at least (decimal numbers for hex; for words in any language it is 0.055 to
#: 0.08, less with capitals, digits and separators between), and the part of three equal signs beyond its square.
TEXT_PAIR = tuple(0.1 if len(x) == 16 else 0.042 for _, _, x in ENCODINGS)
TEXT_TRIPLE = tuple(0.0 if len(x) == 16 else 0.0008 for _, _, x in ENCODINGS)
#: A token is unlike noise where the tests, joined by Bonferroni, give less than this.
ODD = 0.001
#: Length bands of the false-discovery control; its level; steps of -log10(p).
BANDS, LEVEL, STEPS_PER_DECADE, DECADES = (24, 32, 48, 64, 96), 0.05, 10, 30


#: Elements of a block of a running sum; code points of a chunk of text.
_BLOCK, _CHUNK = 256, 4096


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of non-negative longs what merge, sum or greatest, makes of those before it; 0 for the first.

    Within a block, and over the blocks, results are appended one by one; a block is short, and blocks are few.
    """
    zero = F.lit(0).cast("long")

    def steps(x: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(x, start, lambda a, v: F.struct(merge(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def by_block(x: Column) -> Column:
        block = lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK)
        blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int"))
        firsts = steps(F.transform(blocks, lambda b: F.aggregate(block(b), zero, merge)), zero)
        return F.when(F.size(x) == 0, F.array().cast("array<long>")).when(F.size(x) <= _BLOCK, steps(x, zero)).otherwise(F.flatten(F.zip_with(blocks, firsts, lambda b, at: steps(block(b), at))))

    return let(values, by_block)


def _positions(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches of a pattern."""
    length = lambda x: F.length(x).cast("long")

    def places(m: Column) -> Column:
        gaps = F.transform(F.slice(m["gaps"], 1, F.size(m["found"])), length)
        before = running(F.zip_with(gaps, m["found"], lambda g, f: g + F.length(f)), lambda a, v: a + v)
        return F.transform(
            F.arrays_zip(before.alias("before"), gaps.alias("gap"), m["found"].alias("found")),
            lambda x: F.struct((x["before"] + x["gap"]).alias("start"), (x["before"] + x["gap"] + F.length(x["found"])).alias("end"), x["found"].alias("value")),
        )

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), places)


def replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with fill(span, end of the spans before) in place of each span; spans are sorted by start and may overlap."""

    def whole(e: Column) -> Column:
        def cut(a: Column, z: Column) -> Column:
            i, j = F.floor(a / _CHUNK).cast("int"), F.floor(z / _CHUNK).cast("int")
            chunk = lambda at: F.coalesce(F.get(e["chunks"], at), F.lit(""))
            inner = (a - F.lit(_CHUNK) * i + 1).cast("int")
            far = F.concat(F.substring(chunk(i), inner, F.lit(_CHUNK)), F.array_join(F.slice(e["chunks"], i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(chunk(j), F.lit(1), (z - F.lit(_CHUNK) * j).cast("int")))
            return F.when(a >= z, F.lit("")).when(i == j, F.substring(chunk(i), inner, (z - a).cast("int"))).otherwise(far)

        def pieces(before: Column) -> Column:
            return F.zip_with(e["spans"], before, lambda s, b: F.concat(cut(b, F.greatest(b, s["start"])), fill(s, b)))

        last = F.array_max(F.transform(e["spans"], lambda s: s["end"]))
        ends = running(F.transform(e["spans"], lambda s: s["end"]), lambda a, v: F.greatest(a, v))
        return F.concat(F.array_join(let(ends, pieces), ""), cut(last, F.length(e["text"]).cast("long")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(text.alias("text"), chunks.alias("chunks"), spans.alias("spans")), whole))


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation (error below 1e-7 of the middle)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(token: Column) -> Column:
    """Struct (encoding, p) of a token: p is the chance that text of its encoding looks as random; 1 where it is no noise either.

    Padding isn't tested, nor are words and numbers that head a key (HEADED). Every token of TOKEN has an encoding, so none goes untested. One of
    fewer than two of the classes digit, small and capital letter is a word or number: its p is 1.
    """
    bare = let(F.regexp_replace(token, "=+$", ""), lambda t: let(F.regexp_extract(t, HEADED, 1), lambda key: F.when(key != "", key).otherwise(t)))
    return let(bare, _tested)


def _tested(bare: Column) -> Column:
    """battery() of what is left of a token."""
    code = F.coalesce(*[F.when(bare.rlike(pattern), F.lit(i)) for i, (_, pattern, _) in enumerate(ENCODINGS)])
    of = lambda e, values: F.element_at(F.array(*[F.lit(x) for x in values]), e["code"] + 1)
    mixed = sum(bare.rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]")) >= 2

    def places(e: Column) -> Column:
        alphabet = of(e, [x for _, _, x in ENCODINGS])
        folded = F.when(e["code"].isin(*[i for i, (name, _, _) in enumerate(ENCODINGS) if name in FOLDED]), F.lower(e["bare"])).otherwise(e["bare"])
        return F.struct(e["code"].alias("code"), alphabet.alias("alphabet"), F.length(alphabet).alias("k"), folded.alias("folded"))

    def counts(e: Column) -> Column:
        n = F.length(e["folded"])
        squares = F.aggregate(F.sequence(F.lit(1), e["k"]), F.lit(0.0), lambda a, v: a + F.pow((n - F.length(F.replace(e["folded"], F.substring(e["alphabet"], v, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0)))
        alnum = F.regexp_replace(e["folded"], "[+/_-]", "")
        x = F.transform(F.filter(F.split(e["folded"], ""), lambda c: c != ""), lambda c: F.instr(e["alphabet"], c) - 1 - (e["k"] - 1) / 2)
        lag = let(x, lambda y: F.aggregate(F.zip_with(F.slice(y, 1, F.size(y) - 1), F.slice(y, 2, F.size(y) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
        runs = F.length(F.regexp_replace(alnum, "[0-9]++|[a-z]++|[A-Z]++", "x"))
        return F.struct(e["code"].alias("code"), e["k"].cast("double").alias("k"), n.cast("double").alias("n"), squares.alias("squares"), (runs - 1.0).alias("switches"), (F.length(alnum) - 1.0).alias("m"), lag.alias("lag"))

    def scores(e: Column) -> Column:
        k, n, m = e["k"], e["n"], e["m"]
        spread = 2 / (9 * (k - 1))
        w, q, pair, triple = (of(e, v) for v in (NOISE_SWITCH, TEXT_SWITCH, TEXT_PAIR, TEXT_TRIPLE))
        chi = F.greatest(e["squares"] * k / n - n, F.lit(0.0))
        z_chi = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        z_runs = F.abs(e["switches"] - m * w) / F.sqrt(m * w * (1 - w))
        z_serial = F.abs(e["lag"]) / (F.sqrt(n - 1) * (k * k - 1) / 12)
        noise = 3 * F.least(_tail(z_chi), 2 * _tail(z_runs), 2 * _tail(z_serial))
        pairs = n * (n - 1)
        z_pairs = (pairs * pair - (e["squares"] - n)) / F.sqrt(4 * pairs * (n - 2) * triple + 2 * pairs * (pair - pair * pair))
        z_text = (e["switches"] - m * q) / F.sqrt(m * q * (1 - q))
        return F.struct(e["code"].alias("encoding"), F.when(noise >= ODD, _tail((z_pairs + z_text) / math.sqrt(2))).otherwise(F.lit(1.0)).alias("p"))

    done = let(let(let(F.struct(code.alias("code"), bare.alias("bare")), places), counts), scores)
    return F.when(mixed, done).otherwise(F.struct(code.alias("encoding"), F.lit(1.0).alias("p")))


def _band(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def _step(p: Column) -> Column:
    """p as a step of -log10(p), 0 for 1 and DECADES * STEPS_PER_DECADE at most."""
    return F.least(F.lit(DECADES * STEPS_PER_DECADE), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS_PER_DECADE).cast("int"))


_SPAN = "struct<start:long,kind:int,end:long,value:string,encoding:int,p:double>"


def scan(docs: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """docs with a column out: array of (start, kind, end, value, encoding, p) by start and kind, kind as a place in KINDS, p null but for random.

    random spans aren't judged yet; they are looked for in what the fixed patterns' spans leave.
    """
    t, base = fresh(docs, "text_in", "base_spans")
    span = lambda s, kind, code, p: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"], s["value"], code.cast("int").alias("encoding"), p.cast("double").alias("p"))
    none = F.array().cast(f"array<{_SPAN}>")

    def held(kind: int, hint: Column, pattern: str, ok=lambda v: F.lit(True)) -> Column:
        spans = F.transform(F.filter(_positions(F.col(t), pattern), lambda s: ok(s["value"])), lambda s: span(s, kind, F.lit(None), F.lit(None)))
        return F.when(hint, spans).otherwise(none)

    low = F.lower(F.col(t))
    hint = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        hint = hint | F.contains(low, F.lit(word))
    df = docs.withColumn(t, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    df = df.withColumn(
        base,
        F.array_sort(
            F.concat(
                held(0, hint, ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8),
                held(1, F.contains(F.col(t), F.lit("AKIA")), ACCESS),
                held(2, F.col(t).rlike(HEX), HEX),
            )
        ),
    )
    blank = replaced(F.col(t), F.col(base), lambda s, b: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(b, s["start"]), F.lit(0)).cast("int")))
    tested = F.transform(_positions(blank, TOKEN), lambda s: let(battery(s["value"]), lambda r: span(s, 3, r["encoding"], r["p"])))
    return df.withColumn(out, F.when(F.col(t).rlike(TOKEN), F.array_sort(F.concat(F.col(base), tested))).otherwise(F.col(base))).drop(t, base)


def thresholds(scanned: DataFrame, found: str = "found", level: float = LEVEL) -> dict[int, int]:
    """Per length band the step of -log10(p) from which a token is reported, by Benjamini-Hochberg at that level.

    Only a histogram of (band, step) leaves the executors: at most len(BANDS) * (DECADES * STEPS_PER_DECADE + 1) rows,
    however large the corpus.
    """
    c = F.explode(F.filter(F.col(f"`{found}`"), lambda s: s["kind"] == 3))
    rows = scanned.select(c.alias("s")).groupBy(_band(F.col("s.end") - F.col("s.start")).alias("band"), _step(F.col("s.p")).alias("step")).count().collect()
    out = {}
    for band in range(len(BANDS)):
        steps = sorted(((r["step"], r["count"]) for r in rows if r["band"] == band), reverse=True)
        total, seen, cut = sum(n for _, n in steps), 0, DECADES * STEPS_PER_DECADE + 1
        for step, n in steps:
            seen += n
            if 10 ** (-step / STEPS_PER_DECADE) <= level * seen / total:  # the largest p of this step
                cut = step
        out[band] = cut
    return out


def find_secrets(docs: DataFrame, text: str = "text", out: str = "found", level: float = LEVEL) -> DataFrame:
    """docs with the array out of secrets (start, kind, end, value, encoding, p) in code points, end exclusive.

    Kinds 0..2 are the fixed patterns. Kind 3 are tokens of TOKEN that the battery can't tell from noise and that text of their
    encoding would hardly look like: among all tokens of a length band in the corpus those whose p Benjamini-Hochberg
    passes at LEVEL, so that at most that share of the reported ones are text. A null or empty text has none; very long
    texts are scanned whole, in time that grows with their length. Each of repeated rows keeps its row, other columns
    stay as they are whatever their names; a column named out is replaced. An empty table gives none.
    """
    ids = fresh(docs, "scan_out")[0]
    scanned = stored(scan(docs, text, ids))
    cut = thresholds(scanned, ids, level)
    limit = lambda s: F.coalesce(*[F.when(_band(s["end"] - s["start"]) == b, F.lit(v)) for b, v in cut.items()])
    judged = F.filter(F.col(ids), lambda s: (s["kind"] < 3) | (_step(s["p"]) >= limit(s)))
    return scanned.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], judged.alias(out))


def spans_string(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, numbers of spans by fixed pattern, digest of their positions, and all spans."""
    found = find_secrets(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_string(base), 256).alias("base_sha256"), spans_string(F.col("found")).alias("spans"), count(3).alias("n_random"))


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by <kind>; of overlapping spans the first, extended, counts."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    return replaced(text, found, lambda s, b: F.when(s["start"] >= b, F.element_at(names, s["kind"] + 1)).otherwise(F.lit("")))
