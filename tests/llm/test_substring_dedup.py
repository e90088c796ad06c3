"""Removal of repeated windows against brute force over all windows."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import substring_dedup as module
from tracewright.llm.substring_dedup import Cell, RollingHashes, intervals, substring_dedup


def brute(rows, window=20):
    """rows: (doc_id, text), in the order that decides; equal rows are one document."""
    seen, out = {}, {}
    for place, (doc_id, text) in enumerate(dict.fromkeys(rows)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        covered = set()
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (place, i)) != (place, i):
                covered.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in covered)
        out[doc_id, text] = (doc_id, len(words), len(covered), sha256(kept.encode()).hexdigest())
    return [out[r] for r in rows]


def _key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.fixture(params=["one chunk", "many"])
def chunks(request, monkeypatch):
    if request.param == "many":
        monkeypatch.setattr(module, "CHUNK", 150)
        monkeypatch.setattr(module, "BUCKET", 60)


def passages(seed=5):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    shared = [words(n) for n in (20, 21, 60, 19)]
    rows = []
    for d in range(60):
        parts = [words(rng.randrange(0, 50))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), words(rng.randrange(0, 12))]
        rows.append((d, " ".join(w for p in parts for w in p)))
    rows += [(100 + i, rows[7][1]) for i in range(25)]  # copies
    rows.append((200, " ".join(["same"] * 90)))
    return rows


def test_equals_brute_force(spark, chunks):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in substring_dedup(docs).collect()), key=_key) == sorted(brute(rows), key=_key)


def test_odd_rows(odd_docs, chunks):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    last = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = substring_dedup(odd_docs)
    assert sorted((tuple(r) for r in got.collect()), key=_key) == sorted(brute(last), key=_key)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert substring_dedup(odd_docs.limit(0)).count() == 0


def test_texts_of_one_id_and_repeated_rows(spark, chunks):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text + " more"), (-5, None), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in substring_dedup(docs, with_text=True).collect()), key=_key)
    assert [r[:3] for r in got[-2:]] == [(None, 40, 40)] * 2 and got[0][:3] == (-5, 0, 0)
    first, second = ({r[2] for r in got if r[1] == n and r[0] == 1} for n in (40, 41))
    # whichever of the two texts comes first by its hash keeps its words, the repeated row included
    assert (first, second) in (({0}, {40}), ({40}, {0}))


def test_whole_table(spark, chunks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    if module.CHUNK == 150:
        module.CHUNK, module.BUCKET = 5_000, 9_000
    got = sorted((tuple(r) for r in substring_dedup(docs).collect()), key=_key)
    assert got == sorted(brute(rows), key=_key)
    assert sum(r[2] > 0 for r in got) > 10


def test_kept_text_and_intervals(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "x " + text + " y")], "doc_id long, text string")
    row = substring_dedup(docs, with_text=True).where("doc_id = 2").first()
    assert row["kept"] == "x y" and row["removed"] == [[1, 31]] and row["n_removed"] == 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=4, max_size=80))
def test_rolling_hashes_tell_windows_apart(ids):
    a, b = RollingHashes(4).of(np.array(ids), [b"x", b"y", b"z"])
    windows = [tuple(ids[i : i + 4]) for i in range(len(ids) - 3)]
    assert len(a) == len(windows)
    assert len(set(windows)) == len(set(a.tolist())) == len(set(zip(windows, a.tolist(), b.tolist(), strict=True)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 64) - 1), max_size=9), max_size=4))
def test_cells(lists):
    assert [x.tolist() for x in Cell.read(Cell.of(*(np.array(x, np.uint64) for x in lists)))] == lists


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 80), min_size=1))
def test_intervals(starts):
    begins, ends = intervals(np.array(sorted(starts)), 5)
    assert {i for a, b in zip(begins.tolist(), ends.tolist(), strict=True) for i in range(a, b)} == {i + k for i in starts for k in range(5)}
    assert all(a > b for a, b in zip(begins.tolist()[1:], ends.tolist()[:-1], strict=True))
