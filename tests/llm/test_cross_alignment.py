"""Alignment of two tokenizers against a plain version with the libraries themselves."""

from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import cross_alignment as module
from tracewright.llm.byte_level import load
from tracewright.llm.common import tokenizer_path
from tracewright.llm.cross_alignment import Aligner, ByteLevel, align_tokenizers

BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece

    a = load(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens(libraries, text):
    """(id, bytes) of each token, by A and by B."""
    a, b = libraries
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def groups_of(libraries, text):
    if not text:
        return []
    left, right = tokens(libraries, text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return []
    ends = []
    for side in (left, right):
        at, own = 0, []
        for _, x in side:
            at += len(x)
            own.append(at)
        ends.append(own)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, before = [], 0
    for cut in cuts:
        out.append(tuple([i for (i, _), e in zip(side, own, strict=True) if before < e <= cut] for side, own in zip((left, right), ends, strict=True)))
        before = cut
    return out


def brute(libraries, rows):
    groups = {t: groups_of(libraries, t) for _, t in rows}
    links = {t: Counter((x, y) for a, b in g for x in a for y in b) for t, g in groups.items()}
    counts = Counter(p for _, t in rows for p in links[t])
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d, t in rows:
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups[t])
        out.append((
            d, sum(len(a) for a, _ in groups[t]), sum(len(b) for _, b in groups[t]), len(groups[t]), links[t].total(), sum(n for p, n in links[t].items() if counts[p] == best[p[0]]),
            sum(n * counts[p] for p, n in links[t].items()), sha256(told.encode()).hexdigest() if groups[t] else "",
        ))
    return out


def _key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeth  \n.,'ẞ日é1\t\xa0\x00<|endoftext|>s\U0001f600"), max_size=60))
def test_both_ways_of_the_byte_level_file(libraries, text):
    a = ByteLevel(BYTES) if not hasattr(test_both_ways_of_the_byte_level_file, "kept") else test_both_ways_of_the_byte_level_file.kept
    test_both_ways_of_the_byte_level_file.kept = a
    assert a.fast is not None
    assert a.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_a_run_longer_than_the_fast_way_takes(libraries):
    text = " " * 1_000_001 + "x"
    assert Aligner.of(BYTES, PIECES).a.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("large", [10_000, 1])
def test_documents(odd_docs, spark, libraries, monkeypatch, large):
    monkeypatch.setattr(module, "LARGE", large)
    monkeypatch.setattr(module, "AT_ONCE", 50)
    monkeypatch.setattr(module, "CHUNK", 120)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    more = [(20, "qzxqzxqzx" * 30), (21, "日本語テキスト" * 9), (22, "a  b   c\n\n\nd"), (23, "x▁y"), (24, rows[0][1]), (25, "<0x0A> </s> <unk>"), (26, "▁")]
    both = odd_docs.select("doc_id", "text", "n_tokens").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in align_tokenizers(both.repartition(3), BYTES, PIECES).collect()), key=_key)
    assert got == sorted(brute(libraries, rows + more), key=_key)
    assert next(r for r in got if r[0] == 23)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert align_tokenizers(odd_docs.limit(0), BYTES, PIECES).count() == 0


def test_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in align_tokenizers(docs, BYTES, PIECES).collect()), key=_key)
    assert got == sorted(brute(libraries, rows), key=_key)
