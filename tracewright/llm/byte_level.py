"""Encoding whole texts with a byte-level BPE file of the tokenizers library, segment by segment.

A boundary between a character that is no white space and a following space or line end is stable: no pattern of
the byte-level splitter reaches over it, whatever stands further left or right, and no special string holds a space.
Texts are cut there; the library encodes each new segment once and a dictionary of bounded size keeps its ids.  A line end in
front and marks behind, which the splitter always parts from a word, are looked up apart; a word of Latin letters, one piece to
the splitter, goes straight to the library's merges.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .sentencepiece_bpe import Remembered

#: What keeps a text from the plain way: runs of white space, and white space other than spaces and line ends.
RUNS = ("  ", "\n\n", " \n", "\n ", *"\t\r\v\f\x1c\x1d\x1e\x1f")
WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")
STABLE = re.compile(r"(?<=\S)(?=[ \n])")
LONGEST = 1 << 26  # characters of a text that is looked up with others
MARKS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"  # none that a special string or a contraction may begin with


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Pieces(Remembered):
    """Ids by key; keys that the splitter always parts are put together from their parts."""

    def __missing__(self, key: str) -> bytes:
        if key.isalpha():
            return super().__missing__(key)
        lead = "\n\n" if key[:2] == "\n\n" else ""
        body = key[len(lead) :]
        word = body.rstrip(MARKS)
        if word != body and word.isalpha():
            ids = self[lead + word] + self["\n\n" + body[len(word) :]]
        elif key[:1] == "\n" and not lead and key[1:] and not key[1].isspace():
            ids = self["\n"] + self["\n\n" + key[1:]]
        else:
            return super().__missing__(key)
        self[key] = ids
        return ids


class SegmentEncoder:
    """Ids of a text as little-endian bytes of `width` each; kept per Python worker."""

    _kept: dict[str, "SegmentEncoder"] = {}

    @classmethod
    def of(cls, path: str) -> "SegmentEncoder":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, most_kept: int = 500_000):
        self.tokenizer = load(path)
        self.merges = self.tokenizer.model
        self.signs = self._signs()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"  # native order, little-endian on all of Spark's platforms
        self.known = Pieces(self._learn, most_kept)

    def _signs(self) -> dict[int, str] | None:
        """The sign of each byte in the vocabulary, as byte-level files write them; None if words may not go straight to the merges."""
        told = json.loads(self.tokenizer.to_str())
        split = told["pre_tokenizer"] or {}
        if told["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or any(t["content"].isalpha() for t in told["added_tokens"]):
            return None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    @staticmethod
    def plain(text: str) -> bool:
        """Whether single spaces and line ends, none in front, are all the white space of a text."""
        return not (text[0] in " \n" or any(x in text for x in RUNS) or not text.isascii() and WIDE_SPACE.search(text))

    @classmethod
    def keys(cls, text: str) -> list[str]:
        """A key stands for a space and itself; one that begins with a line end for itself; behind two line ends for the rest."""
        if cls.plain(text):
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = "\n\n" + keys[0]
            return keys
        return ["\n\n" + s for s in STABLE.split(text)]

    def _learn(self, key: str) -> bytes:
        if self.signs and key.isascii() and key.isalpha():  # most of all keys
            return array(self.code, [t.id for t in self.merges.tokenize(self.signs[32] + key)]).tobytes()
        text = key[2:] if key[:2] == "\n\n" else key if key[:1] == "\n" else " " + key
        word = text[1:] if text[:1] == " " else text
        if self.signs and word.isalpha() and max(word) < "\u0250":
            shown = text.replace(" ", self.signs[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.signs)
            ids = [t.id for t in self.merges.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.keys(text))) if text else b""

    def encode_all(self, column) -> list[bytes]:
        """encode() of every text of an Arrow column.  Arrow tells the keys of plain texts apart, and each is looked up once for all its places."""
        import pyarrow as pa
        import pyarrow.compute as pc

        given = column.to_pylist()
        plain = [bool(t) and len(t) <= LONGEST and self.plain(t) for t in given]
        if not any(plain):
            return [self.encode(t) for t in given]
        keys = pc.split_pattern(pc.binary_join_element_wise("\n\n", pc.replace_substring(column.filter(pa.array(plain)), "\n", " \n"), ""), " ")  # as keys() has them
        coded = keys.flatten().dictionary_encode()
        known = list(map(self.known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = np.frombuffer(b"".join(known), f"<u{self.width}")
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        place = coded.indices.to_numpy()
        n = size[place]
        ends = np.cumsum(n)
        spread = ids[np.repeat((np.cumsum(size) - size)[place] - ends + n, n) + np.arange(int(n.sum()))].tobytes()
        cuts = (np.r_[0, ends][keys.offsets.to_numpy() - keys.offsets[0].as_py()] * self.width).tolist()
        found = map(spread.__getitem__, map(slice, cuts, cuts[1:]))
        return [next(found) if p else self.encode(t) for p, t in zip(plain, given, strict=True)]
