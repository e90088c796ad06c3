"""SentencePiece (BPE models) encoding and decoding by a prefix table.

Method: for every prefix of a segment keep the one token that the encoding of this prefix ends with.  An
Aho-Corasick automaton over the pieces gives all pieces that end at a position; a piece may be the last one
if the piece before it (the table's entry where the piece begins) and the piece itself stay apart when the
merge rule is run on just the two.  Exactly one candidate passes, so the ids come out backwards in linear time.

Why it is exact: merges left and right of a boundary that no merge crosses do not influence each other, and the
first merge to cross a boundary would also be made in the text of the two neighbours alone.

Segments: when no piece holds the space mark after another character, no merge crosses the front of a run of
marks; characters outside all longer pieces are never merged at all.  Both cut the text into segments, whose
results are kept in a dictionary of bounded size.

Nulls and empty texts: no ids, empty decoded text.  Repeated rows: one result each.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from .common import texts

MARK = "▁"


class PrefixTableCodec:
    """Encoder and decoder for one model file; kept per Python worker."""

    _kept: dict[str, "PrefixTableCodec"] = {}

    @classmethod
    def of(cls, path: str) -> "PrefixTableCodec":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, most_kept: int = 150_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = {i: int(self.pieces[i][3:-1], 16) for i in range(n) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.id_of = {
            p: i
            for i, p in enumerate(self.pieces)
            if i not in self.bytes_of and i not in self.silent and i != self.unknown and not model.is_unused(i)
        }
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.touching = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}  # no merge joins other pairs
        self.merging = {c for p in self.id_of if len(p) > 1 for c in p}
        self.whole = {i for p, i in self.id_of.items() if self._merge(p) == [p]}
        self.apart: dict[tuple[int, int], bool] = {}
        self.cuts_at_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        self.cuts_at_lines = "\n" not in self.merging
        self.known = Remembered(self._ids_of_key, most_kept)
        self.text_of = {str(i): p.replace(MARK, " ") for i, p in enumerate(self.pieces) if self.id_of.get(p) == i}
        self.text_of |= {str(i): chr(b) for i, b in self.bytes_of.items() if b < 128}

    def _merge(self, text: str) -> list[str]:
        """The defining rule, for short texts: join the best-scored adjacent pair, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: int, right: int) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > 200_000:
                self.apart.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.apart[left, right] = self._merge(a + b) == [a, b]
        return found

    def segment_ids(self, text: str) -> list[int]:
        """Ids of one segment (marks already in place) by the prefix table."""
        n = len(text)
        last: list[int] = [-1] * (n + 1)  # by prefix length: the id of its last token; -2: bytes of a character
        size = [1] * (n + 1)
        last[0] = -2
        apart, whole = self.apart, self.whole
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before >= 0:
                stay = apart.get((before, token))
                if stay or stay is None and self._stay_apart(before, token):
                    last[end], size[end] = token, length
            elif token in whole:
                last[end], size[end] = token, length
        out: list[int] = []
        i = n
        while i > 0:
            if last[i] < 0:
                out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(text[i - 1].encode()))
            else:
                out.append(last[i])
            i -= size[i]
        out.reverse()
        return out

    def _keys(self, text: str) -> list[str]:
        """Segments of a text; a key stands for itself behind one mark, or alone if it begins with a line end."""
        text = text.replace(MARK, " ")
        if not (self.cuts_at_marks and self.cuts_at_lines):
            return [text.replace(" ", MARK)]
        if text[0] != " " and "  " not in text:
            return text.replace("\n", " \n").split(" ")
        parts = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*", MARK + text.replace(" ", MARK))
        return [p if p[0] == "\n" else p[1:] for p in parts]

    def _ids_of_key(self, key: str) -> str:
        if len(key) > 1 and key[-1] in ".,;:!?" and key[-2:] not in self.touching:
            ids, head = self.segment_ids(key[-1]), self.known[key[:-1]]
        else:
            ids, head = self.segment_ids(key if self.cuts_at_lines and key[:1] == "\n" else MARK + key), ""
        return head + "".join([f"{i}," for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.digest(text)[1].split(",")] if text else []

    def decode(self, ids: list[int], start: bool = True) -> str:
        """start: the ids begin a text, so the mark put before it goes."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.bytes_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append("" if i in self.silent else " ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(run))
        text = "".join(out)
        return text[1:] if start and text[:1] == " " and ids and ids[0] not in self.bytes_of else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of one whole text, segment by segment."""
        if not text:
            return 0, "", ""
        keys = self._keys(text)
        joined = "".join(map(self.known.__getitem__, keys))[:-1]
        ids = joined.split(",")
        try:
            decoded = "".join(map(self.text_of.__getitem__, ids))
        except KeyError:  # bytes of longer characters
            return len(ids), joined, self.decode([int(i) for i in ids])
        return len(ids), joined, decoded[1:] if decoded[0] == " " else decoded


class Remembered(dict):
    """A dictionary that works out what it lacks.  When full it becomes the older of two generations."""

    def __init__(self, work_out: Callable[[str], Any], most: int):
        self.work_out, self.most, self.older = work_out, most, {}

    def __missing__(self, key: str) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.work_out(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def _utf8(run: bytearray) -> str:
    """Bytes that are no character give one replacement each."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + n]).decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, hashes of ids and decoded text, and with_ids the ids and the decoded text themselves."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = PrefixTableCodec.of(model_path)

        def made(docs: list, rows: list) -> pa.RecordBatch:
            counts, ids, decoded = zip(*rows, strict=True)
            digests = [pa.array([sha256(x.encode()).hexdigest() for x in texts_], pa.string()) for texts_ in (ids, decoded)]
            cols, names = [pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.fromstring(",".join(x for x in ids if x), np.int32, sep=",")
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            docs, rows, held = [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                docs.append(batch.column(0)[i].as_py())
                rows.append(codec.digest(text))
                held += len(text)
                if held > 2_000_000:  # little at once, however long the texts
                    yield made(docs, rows)
                    docs, rows, held = [], [], 0
            if docs:
                yield made(docs, rows)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))
