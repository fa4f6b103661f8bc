"""SentencePiece models as weighted transducers.

Three machines are compiled from a model. N, the normaliser, maps a text to symbols: its character map rewrites the longest
match at each place, then a table of arcs over (state, space or not) drops or marks spaces. P maps symbols to pieces with a weight
each, B a symbol outside all pieces to byte pieces. The encoding of a text is the shortest path, in the tropical semiring
(weights add along a path, the least path wins), of text o N o (P | B). A unigram model weighs a piece by its score. A merge
model weighs each piece 1, and an acceptor A joins in that holds the arcs (piece, next piece) such that merging both pieces'
symbols gives just these two: the sequences that A accepts are the encodings that merging makes, one for each string. Arcs of
A, and paths over the words that N writes, are worked out when first met.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_row

SPACE = "▁"
# Fixed values of the model file: message fields and kinds of piece.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _MERGES = 1, 2
#: Weight of an unknown symbol without byte fallback, above all pieces' weights, and limits of what is kept in memory.
_UNKNOWN_EXTRA, _KEPT = 10.0, 400_000
_CACHE: dict[str, Transducer] = {}
ENCODED = "n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean, ids binary"


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: numbers as int, the others as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = b[at]
            at += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while at < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value, at = b[at : at + n], at + n
        yield tag >> 3, value


class Normalizer:
    """N: (state, whether the symbol is a space) -> (what is written before the symbol, whether the symbol is, next state)."""

    START, INSIDE, GAP = range(3)

    def __init__(self, prefix: bool, collapse: bool, escape: bool, charsmap: bytes = b"") -> None:
        mark = SPACE if escape else " "
        begin = mark if prefix else ""
        start, inside, gap = self.START, self.INSIDE, self.GAP
        if collapse:  # spaces at the ends go, others are written with the symbol after them
            self.arcs = {(start, True): ("", False, start), (start, False): (begin, True, inside), (gap, True): ("", False, gap), (gap, False): (mark, True, inside), (inside, True): ("", False, gap)}
        else:
            self.arcs = {(start, True): (begin + mark, False, gap), (start, False): (begin, True, inside), (gap, True): (mark, False, gap), (gap, False): ("", True, inside), (inside, True): (mark, False, gap)}
        self.arcs[inside, False] = ("", True, inside)
        #: what is written before the first word, and for one space between two
        self.begin, between, state = begin, *self.arcs[inside, True][::2]
        self.between = between + self.arcs[state, False][0]
        self.units, self.pool = None, b""
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            self.units, self.pool = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist(), charsmap[4 + size :]
            self.maps = re.compile("[" + "".join(map(re.escape, self._firsts())) + "]")

    def _next(self, at: int, byte: int) -> int:
        """The node below one of the map's double array, -1 without; a node is the place that its children's bytes are XORed to."""
        at ^= byte
        unit = self.units[at] if at < len(self.units) else 0
        return at ^ (unit >> 10 << ((unit & 1 << 9) >> 6)) if unit & (1 << 31 | 0xFF) == byte else -1

    def _root(self) -> int:
        unit = self.units[0]
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def _firsts(self) -> Iterator[str]:
        """First characters of the map's keys."""
        nodes = [(self._root(), b"")]
        while nodes:
            at, head = nodes.pop()
            for byte in range(1, 256):
                below = self._next(at, byte)
                if below >= 0:
                    text = head + bytes([byte])
                    wide = 1 + (text[0] >= 0xC0) + (text[0] >= 0xE0) + (text[0] >= 0xF0)
                    if len(text) == wide:
                        yield text.decode()
                    else:
                        nodes.append((below, text))

    def mapped(self, text: str) -> str:
        """The text with the longest key of the character map at each place rewritten."""
        if self.units is None:
            return text
        out, done = [], 0
        for m in self.maps.finditer(text):
            if m.start() < done:
                continue
            at, found, end = self._root(), None, m.start()
            for k in range(m.start(), len(text)):
                for byte in text[k].encode("utf-8", "surrogatepass"):
                    above, at = at, self._next(at, byte) if at >= 0 else -1
                if at < 0:
                    break
                unit = self.units[above ^ byte]
                if unit >> 8 & 1:
                    found, end = self.units[at] & (1 << 31) - 1, k + 1
            if found is not None:
                out += [text[done : m.start()], self.pool[found : self.pool.index(b"\0", found)].decode()]
                done = end
        return "".join([*out, text[done:]])

    def words(self, text: str) -> Iterator[str]:
        """What N writes for a mapped text, in parts that begin with a mark where there is one."""
        state, held = self.START, ""
        for k, word in enumerate(text.split(" ")):
            if k:
                before, _, state = self.arcs[state, True]
                held += before
            if word:
                before, _, state = self.arcs[state, False]
                yield held + before + word
                held = ""
        if held:
            yield held


class Kept(dict):
    """Results by key, worked out when first asked for, up to a size in bytes. Those not asked for since the last but one time it was
    full go. Long keys, such as text without spaces, are worked out each time."""

    LONGEST, SIZE = 64, 48 << 20

    def __init__(self, make, size: int = SIZE) -> None:
        self.make, self.most, self.size, self.old = make, size, 0, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) > self.LONGEST:
            return out
        self.size += 200 + len(key) + len(out)  # with what Python adds
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = out
        return out


class Transducer:
    """The composed transducer of a model."""

    def __init__(self, model: bytes) -> None:
        self.text, self.kind, self.weight = [], [], []
        self.merges, spec = False, {"prefix": True, "collapse": True, "escape": True, "charsmap": b""}
        for field, value in _fields(model):
            if field == _PIECES:
                piece, score, kind = "", 0.0, _NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.text.append(piece)
                self.kind.append(kind)
                self.weight.append(-score)
            elif field == _TRAINER:
                for f, v in _fields(value):
                    if f == 3:
                        self.merges = v == _MERGES
            elif field == _NORMALIZER:
                for f, v in _fields(value):
                    if f == 2:
                        spec["charsmap"] = v
                    elif f in (3, 4, 5):
                        spec[{3: "prefix", 4: "collapse", 5: "escape"}[f]] = bool(v)
        self.normalizer, self.prefix, self.escape = Normalizer(**spec), spec["prefix"], spec["escape"]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k in (_NORMAL, _USER)}
        self.bytes = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.kind) if k == _BYTE}
        self.unknown = self.kind.index(_UNKNOWN)
        self.is_byte = np.array(self.kind) == _BYTE
        #: what each id decodes to
        self.shown = ["" if k == _CONTROL else t for t, k in zip(self.text, self.kind, strict=True)]
        self.shown[self.unknown] = " \u2047 "
        self.shown = [x.encode() for x in self.shown]
        for b, i in self.bytes.items():
            self.shown[i] = bytes([b])
        self.begins = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        #: P: the weight of each piece, infinite for what only begins one
        self.arcs = dict.fromkeys(self.begins, float("inf")) | {t: 1.0 if self.merges else self.weight[i] for t, i in self.ids.items()}
        self.inside = {t[n : n + 2] for t in self.ids for n in range(len(t) - 1)}
        #: B: the weight of a symbol outside all pieces, above all pieces' weights
        self.strange = 1.0 if self.merges else max(self.weight[i] for i in self.ids.values()) + _UNKNOWN_EXTRA
        self.joined: dict[str, dict[str, bool]] = {}
        self.n_joined = 0
        self.known = Kept(lambda s: array("I", self.shortest_path(s)).tobytes())
        self.word = Kept(self._run)
        self.after = Kept(lambda w: self._run(self.normalizer.between + w))
        #: what N writes can be encoded word by word where no piece goes on over a mark, line by line where none holds a line break
        mark = SPACE if self.escape else " "
        self.by_word = not any(b == mark != a for a, b in self.inside)
        self.by_line = not any("\n" in t for t in self.ids)

    def _merged(self, symbols: str) -> list[str]:
        """What merging makes of a short string: the adjacent pair of least weight first, leftmost of equals."""
        parts = list(symbols)
        while True:
            best = min(((self.weight[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _arc(self, last: str, piece: str) -> bool:
        """Whether A has the arc from one piece to the next; kept."""
        out = self._merged(last + piece) == ([last, piece] if last else [piece])
        self.joined.setdefault(last, {})[piece] = out
        self.n_joined += 1
        if self.n_joined > 2 * _KEPT:
            self.joined.clear()
            self.n_joined = 0
        return out

    def _fallback(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def shortest_path(self, s: str) -> list[int]:
        """Ids along the path of least weight over the symbols s, the earliest arc first among equals.

        A state is a place and, with A joined in, the last piece. As A accepts one sequence for each string, a place is
        reached with one last piece then, so in either kind of model a place has one least path to it.
        """
        n, infinite = len(s), float("inf")
        least, before = [0.0] + [infinite] * n, [0] * (n + 1)
        weight, merges, joined, arc = self.arcs.get, self.merges, self.joined, self._arc
        for at in range(n):
            base = least[at]
            if base == infinite:
                continue
            if merges:
                last = s[before[at] : at]
                accepted = joined.get(last)
                if accepted is None:
                    accepted = joined[last] = {}
            end = at + 1
            piece = s[at:end]
            if piece not in self.ids and base + self.strange < least[end] and (not merges or arc(last, piece)):
                least[end], before[end] = base + self.strange, at
            w = weight(piece)
            while w is not None:
                if base + w < least[end]:
                    ok = True
                    if merges:
                        ok = accepted.get(piece)
                        if ok is None:
                            ok = arc(last, piece)
                    if ok:
                        least[end], before[end] = base + w, at
                end += 1
                if end > n:
                    break
                piece = s[at:end]
                w = weight(piece)
        out: list[list[int]] = []
        at = n
        while at > 0:
            piece = s[before[at] : at]
            out.append([self.ids[piece]] if piece in self.ids else self._fallback(piece))
            at = before[at]
        return [i for part in reversed(out) for i in part]

    def _run(self, s: str) -> bytes:
        """Ids of symbols as little-endian 32-bit numbers. No piece lies across two symbols that no piece holds side by side,
        so the paths between such places are found one by one and kept."""
        if s in self.known:
            return self.known[s]
        inside = self.inside
        cut = [0, *(k for k in range(1, len(s)) if s[k - 1 : k + 1] not in inside), len(s)]
        if len(cut) == 2:
            return self.known[s]
        return b"".join([self.known[s[a:z]] for a, z in zip(cut, cut[1:], strict=False)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not self.by_word:
            return self._run("".join(self.normalizer.words(self.normalizer.mapped(text))))
        text = self.normalizer.mapped(text)
        if not text or text[0] == " " or text[-1] == " " or "  " in text:
            parts = self.normalizer.words(text)
        else:  # each space stands between two words, for which N writes the same
            parts = None
        out, lines = [], self.by_line
        if parts is None:
            for k, line in enumerate(text.split("\n") if lines else [text]):
                first, *rest = line.split(" ")
                if k:
                    out.append(self.word["\n"])
                first = first if k else self.normalizer.begin + first
                if first:
                    out.append(self.word[first])
                out += map(self.after.__getitem__, rest)
            return b"".join(out)
        for part in parts:
            if lines and "\n" in part:
                out.append(self.word["\n"].join([self.word[x] if x else b"" for x in part.split("\n")]))
            else:
                out.append(self.word[part])
        return b"".join(out)

    def decode(self, ids: array) -> str:
        """The text back: byte pieces join to characters, the first space goes."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        text = text.replace(SPACE, " ") if self.escape else text
        return text[1:] if self.prefix and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    """One per Python worker."""
    if path not in _CACHE:
        with open(path, "rb") as f:
            _CACHE[path] = Transducer(f.read())
    return _CACHE[path]


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id and ENCODED, the ids of its whole text as little-endian 32-bit numbers and what they decode to.

    A null or empty text has no ids. round_trip is false where decoding can't give the text back: one that holds U+2581
    itself. Bytes that aren't UTF-8 are U+FFFD in what is encoded. Repeated rows are rows each; other columns are ignored. Row by row, without a shuffle.
    """
    import zlib

    def make(rows: list[bytes]) -> dict[str, pa.Array]:
        t = transducer(model)
        out = []
        for b in rows:
            source = b.decode("utf-8", "replace")
            raw = t.encode(source)
            ids = array("I", raw)
            back = t.decode(ids)
            out.append((len(ids), int(t.is_byte[np.frombuffer(raw, np.uint32)].sum()), zlib.crc32(raw), hashlib.sha256(back.encode()).hexdigest(), back == source, raw))
        names = [x.split(" ")[0] for x in ENCODED.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}

    return per_row(docs, [key], text, ENCODED, make)
