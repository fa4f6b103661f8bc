"""Token ids of whole texts by a public tokenizer, encoded once per distinct chunk."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np

END_OF_TEXT, PACK_END = 1, 2
_CACHE = {}


#: Words that the normaliser only puts in lower case and the word rule keeps whole: letters without marks that could join or split.
_SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Such a word and marks after it, which the word rule parts from it.
_MARKS = ".,;:!?#*|%&$<>()"
_MARKED = re.compile(f"({_SIMPLE.pattern})([{re.escape(_MARKS)}]+)")
#: The usual rule of byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class _Known(dict):
    """The ids of pieces met so far, as bytes; learns a piece when it is asked for.

    When they come to SIZE bytes, those not asked for since the time before go. Longer ones than LONGEST, such as text
    without spaces, are encoded each time.
    """

    LONGEST, SIZE = 64, 64 << 20

    def __init__(self, library, kind: str) -> None:
        self.library, self.tokenize, self.kind = library, library.model.tokenize, np.dtype(kind).char
        self[""], self.size, self.old = b"", 0, {}

    def __missing__(self, w: str) -> bytes:
        out = self.old.get(w)
        if out is not None:
            pass
        elif w[-1] in _MARKS and (m := _MARKED.fullmatch(w)):
            out = self[m[1]] + self[m[2]]
        elif _SIMPLE.fullmatch(w):
            low = w.lower()
            out = self[low] if low != w else array(self.kind, [x.id for x in self.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        else:
            out = array(self.kind, self.library.encode(w, add_special_tokens=False).ids).tobytes()
        if len(w) > self.LONGEST:
            return out
        self.size += 200 + len(w) + len(out)  # with what Python adds
        if self.size > self.SIZE:
            self.old, self.size = dict(self), 0
            self.clear()
            self[""] = b""
        self[w] = out
        return out


class Encoder:
    """ids of texts as little-endian bytes, 2 for each id where the vocabulary allows it, else 4.

    The tokenizer drops white space before it looks for words and works on each piece between alone, so that the ids of
    a text are those of its pieces in order. Each distinct piece goes through the library once; a word with a
    full stop or comma has the ids of the word and of the mark, and a word of letters alone goes straight to the
    library's model.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.kind = "<u2" if library.get_vocab_size() <= 1 << 16 else "<u4"
        self.known = _Known(library, self.kind)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
