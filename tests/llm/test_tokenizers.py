"""SentencePiece, token counts and token shards against the libraries themselves."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm.byte_level import SegmentEncoder, load
from tracewright.llm.common import tokenizer_path
from tracewright.llm.sentencepiece_bpe import PrefixTableCodec, encode_documents
from tracewright.llm.token_counts import count_tokens, resync_count
from tracewright.llm.token_shards import WaveletMatrix, pack, token_shards, unpack

MODEL, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")
TEXT = st.text(alphabet=st.sampled_from("abcdeth  \n.,'ẞ日é1▁\t\xa0\x00<|endoftext|>\U0001f600"), max_size=60)


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def library():
    return load(BYTES)


def _key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_sentencepiece_documents(odd_docs, piece):
    got = sorted((tuple(r) for r in encode_documents(odd_docs, MODEL).collect()), key=_key)
    want = []
    for r in odd_docs.collect():
        ids = piece.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(piece.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=_key)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_sentencepiece_text(piece, text):
    codec = PrefixTableCodec.of(MODEL)
    ids = piece.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == piece.decode(ids)
    assert codec.digest(text)[2] == piece.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=30).map("".join))
def test_segments_and_resynchronised_chunks(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(SegmentEncoder.of(BYTES).encode(text), "<u2").tolist() == want
    assert resync_count(library, text, 60, 4) == len(want)


@pytest.mark.parametrize("text", ["x" * 5000, "ab " * 3000, "<|endoftext|>" * 400, "日本" * 2000, " " * 3000, "a\n" * 2000])
def test_resynchronisation_widens(library, text):
    assert resync_count(library, text, 300, 8) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(odd_docs, library):
    got = sorted((tuple(r) for r in count_tokens(odd_docs, BYTES, limit=100, huge=1000, chunk=500, overlap=16).collect()), key=_key)
    want = []
    for r in odd_docs.collect():
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(t.encode()), n, n > 100))
    assert got == sorted(want, key=_key)


def test_token_shards(odd_docs, library, spark):
    docs = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start, want = 0, []
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_shards(odd_docs.repartition(3), BYTES, tokens_per_shard=50).orderBy("start").collect()]
    assert got == want
    assert token_shards(odd_docs.limit(0), BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=300))
def test_wavelet_matrix(values):
    x = np.array(values, np.uint16)
    m, names, ends = unpack(pack(x, [1, None], np.array([0, len(x)])))
    assert names == [1, None] and ends.tolist() == [0, len(x)]
    assert m.all().tolist() == values
    for i, v in enumerate(values[:40]):
        assert m.access(i) == v
        assert m.count(v, 0, i + 1) == values[: i + 1].count(v)
        assert m.select(v, values[:i].count(v)) == i
    assert m.count(999) == 0 and m.select(71, 0) == -1


def test_a_column_of_texts_is_encoded_with_one_lookup_a_key():
    import pyarrow as pa

    encoder = SegmentEncoder(str(BYTES))
    odd = ["", None, "a", " a", "a b", "a\nb", "a \nb", "\n", "x\n\ny", "\u00e9 \u00fc\n\u00f1", "a\u00a0b c", "don't stop, it's", "<s> hi </s>", "tab\tx y", "end\n", "end ", "\u4e2d\u6587 \u5b57"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]
    for column in (pa.array(odd), pa.array(["x y", *odd]).slice(1), pa.array(["", None], pa.string()), pa.array([], pa.string())):
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_all(column)]
        assert got == want[: len(column)] or got == [[]] * len(column)
    asked = []
    known = encoder.known

    class Counting:
        def __getitem__(self, key):
            asked.append(key)
            return known[key]

    encoder.known = Counting()
    text = "some words, some more\nof words"
    assert encoder.encode_all(pa.array([text] * 500)) == [b"".join(known[k] for k in encoder.keys(text))] * 500
    assert sorted(asked) == sorted(set(encoder.keys(text)))


def test_batches_are_gathered_up_to_a_size():
    import pyarrow as pa

    from tracewright.llm.token_shards import gathered

    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["x" * n])], ["doc_id", "text"]) for i, n in enumerate((10, 10, 500, 10, 10))]
    got = [b.column(0).to_pylist() for b in gathered(iter(batches), 100)]
    assert got == [[0, 1], [2], [3, 4]] and not list(gathered(iter([])))
