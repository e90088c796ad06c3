"""Periodic runs against brute force over every stretch of words."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import periodic_runs
from tracewright.llm.periodic_runs import OrderedPositions, collapse_runs, cycled, runs, shared, suffix_order


def brute(words, least=6, periods=4):
    """Maximal stretches by period, then those that have no smaller period."""
    found = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            e = i
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            n = e + q - i
            if e > i and n >= max(least, periods * q) and not any(all(words[k] == words[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, least=6, periods=4, plant=True):
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = brute(words, least, periods)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    top = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda x: sha256(x.encode()).hexdigest()
    return (
        doc_id, len(own), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in own)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@st.composite
def sequences(draw):
    """Words with planted repeats of short blocks, nested ones too."""
    out = []
    for _ in range(draw(st.integers(0, 5))):
        block = draw(st.lists(st.integers(0, 3), min_size=1, max_size=6))
        block = (block * draw(st.integers(1, 4)))[: draw(st.integers(1, 24))]
        out += (block * draw(st.integers(1, 7)))[: draw(st.integers(1, 60))]
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(sequences(), min_size=1, max_size=3), st.sampled_from([(6, 4), (2, 2), (4, 3), (9, 2)]))
def test_runs_equal_brute_force(sequences, limits):
    ids = np.array([x for s in sequences for x in s], np.int64)
    docs = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    if not len(ids):
        return
    got = list(zip(*(x.tolist() for x in runs(ids, docs, *limits)), strict=True))
    want, before = [], 0
    for s in sequences:
        want += [(a + before, n, q) for a, n, q in brute(s, *limits)]
        before += len(s)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_suffixes_in_order(values):
    keys = np.array([*values, 9], np.int64)
    order, levels = suffix_order(keys)
    text = keys.tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = lambda i, j: next(k for k in range(len(text)) if text[i + k] != text[j + k])
    assert shared(levels, order[:-1], order[1:]).tolist() == [lcp(i, j) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.permutations(list(range(40))))
def test_ordered_positions_split_into_blocks(values):
    OrderedPositions.MOST, most = 4, OrderedPositions.MOST
    try:
        held = OrderedPositions(values[0])
        seen = [values[0]]
        for x in values[1:]:
            assert held.add(x) == (max([y for y in seen if y < x], default=-1), min([y for y in seen if y > x], default=-1))
            seen.append(x)
        assert held.all() == sorted(values) and held.size == len(values)
    finally:
        OrderedPositions.MOST = most


def _key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_documents(odd_docs):
    got = sorted((tuple(r) for r in collapse_runs(odd_docs, taken=cycled).collect()), key=_key)
    want = [expected(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect() if r["doc_id"] != 4]
    assert [r for r in got if r[0] != 4] == sorted(want, key=_key)
    long = next(r for r in got if r[0] == 4)  # one word, three thousand times
    assert long[1:6] == (1, 0, 3000, 1, 3_000_000) and long[7] == sha256(b"word").hexdigest()
    assert collapse_runs(odd_docs.limit(0)).count() == 0


def test_whole_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 2_000)
    got = sorted((tuple(r) for r in collapse_runs(docs, taken=cycled).collect()), key=_key)
    small = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 6_000}
    want = sorted((expected(d, t) for d, t in small.items()), key=_key)
    assert [r for r in got if r[0] in small] == want
    assert sum(r[1] > 0 for r in got) > 5


def test_text_and_runs_come_along(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b x"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in collapse_runs(docs, with_text=True).collect()}
    assert rows[1]["collapsed"] == "a b x" and [tuple(x) for x in rows[1]["runs"]] == [(0, 8, 2)]
    assert rows[2]["collapsed"] == "" and rows[2]["runs"] == []


@pytest.mark.parametrize("n", [40_000])
def test_one_very_long_document(spark, n):
    text = " ".join(["x"] * n + [f"w{i}" for i in range(n)] + [f"y{i % 500}" for i in range(n)])
    row = collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_runs"] == 2 and (row["start"], row["length"], row["period"]) == (0, n, 1)
