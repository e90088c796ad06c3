"""License scan, top-k search and mixture: brute force, and their SQL on odd rows."""

import itertools
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import license_scan, mixture, norm_buckets
from tracewright.llm.license_rules import BASE, GATE, signatures


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql)


def _rows(df, cols):
    clean = lambda v: "~" if v is None or v != v else (int(v) if v == int(v) else round(v, 9)) if isinstance(v, float) else v
    return sorted(tuple(str(clean(v)) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


def _same(df, sql, **tables):
    got, want = df.toPandas(), _sql(sql, **tables).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert _rows(got, cols) == _rows(want, cols)


def test_license_scan_sql(odd_docs):
    _same(license_scan.license_scan(odd_docs), license_scan.oracle(), documents=odd_docs)


def test_license_base_by_hand(spark):
    texts = {1: "x GNU\ngeneral-public LICENSE, cc/by CC.BY!", 2: "MIT license MIT License apache license 2.0", 3: "Licensed under CC BY-NC 4.0.", 4: "licence of cc", 5: "mit license" * 3}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        places = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r["labels"].split(","))
    assert got[3]["labels"] == "cc-by,cc-by-nc" and got[3]["score"] == 0.9


def test_license_scan_of_very_long_texts(spark):
    """Hundreds of thousands of matches in one text, within seconds."""
    phrase = "under the mit license and "
    docs = spark.createDataFrame([(1, phrase * 80_000), (2, phrase * 3 + "w " * 600_000 + "Apache License, Version 2.0"), (3, "cc by cc by sa " * 50_000)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (400_000, 80_000, 2, 399_997, "mit")
    assert (got[2]["n_base"], got[2]["last_word"], got[2]["labels"]) == (4, 600_015, "apache,apache-2.0,mit")
    assert (got[3]["n_base"], got[3]["labels"]) == (100_000, "cc-by,cc-by-sa")


def _examples(regex):
    """Texts that a signature matches, one for each of its alternatives and options."""
    m = re.search(r"\(\?:((?:[^()]|\(\?:[^()]*\))*)\)(\??)", regex)
    if not m:
        yield re.sub(r"(.)\?", r"\1", re.sub(r"\[(.)[^\]]*\]", r"\1", regex))
        return
    parts = re.split(r"\|(?![^(]*\))", m[1]) + ([""] if m[2] else [])
    for p in parts:
        yield from itertools.islice(_examples(regex[: m.start()] + p + regex[m.end() :]), 40)


def test_gate_misses_no_signature():
    gate = re.compile(license_scan._gate())
    missed = set()
    for s in signatures():
        for words in itertools.islice(_examples(s.regex), 400):
            if re.fullmatch(s.regex, words) and not gate.search(" " + words.strip()):
                missed.add((s.label, words.strip()))
    assert not missed
    assert all(gate.search(" " + p) for p in BASE) and GATE


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)) * np.exp(spread * rng.normal(size=(400, 1)))
    x[100:130] = x[100]  # ties
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    df = _vectors(spark, rows)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in norm_buckets.top_k(df, norm_buckets.every_nth(df), bucket_rows=40, block=7).collect()}
    q = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    for i in range(0, 400, 20):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(400) if j != i))[:20]
        assert [got[i, k + 1] for k in range(20)] == [(j, -s) for s, j in best]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(2, 30), st.integers(1, 50), max_size=12), st.integers(1, 20))
def test_blocks_by_reach(counts, block):
    where, met = norm_buckets.deal(counts, block, 31)
    assert set(where) == set(counts) and met == sorted(met, reverse=True)
    blocks = sorted({b for first, n in where.values() for b in range(first, first + n)})
    assert blocks == list(range(len(blocks))) and len(blocks) <= sum(counts.values()) // block + len(counts)
    for reach, (first, n) in where.items():
        assert all(first + n <= met[b] for b in range(1, reach))  # a query's block is met by all buckets within its reach
        group = [r for r, at in where.items() if at == (first, n)]
        assert (n - 1) * block < sum(counts[r] for r in group) <= n * block
    for b in range(1, 31):  # and no bucket meets a block that does not reach it
        assert met[b] == sum(n for first, n in set(where.values()) if max(r for r, at in where.items() if at == (first, n)) > b)


def test_candidates_go_to_blocks_within_reach(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 6)) * np.exp(1.2 * rng.normal(size=(1200, 1)))
    df = _vectors(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])
    dealt = []
    plain = norm_buckets.deal
    monkeypatch.setattr(norm_buckets, "deal", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    assert norm_buckets.top_k(df, norm_buckets.every_nth(df, 5), k=5, bucket_rows=60, block=20).count() == 240 * 5
    ((where, met),) = dealt
    assert sum(met[1:]) < 0.6 * len(met[1:]) * (240 // 20 + 1)  # copies of buckets, against every bucket in every block


def _best_of(q, i, k=20):
    scores = [sum(a * b for a, b in zip(q[i], r, strict=True)) for r in q]
    return [(n + 1, j, -s) for n, (s, j) in enumerate(sorted((-s, j) for j, s in enumerate(scores) if j != i)[:k])]


@pytest.mark.parametrize("case", ["one length", "two lengths", "beyond 2**53"])
def test_top_k_of_crowded_lengths_and_large_products(spark, case):
    """More vectors of one length than a bucket holds; and products that doubles do not hold."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8))
    if case == "beyond 2**53":
        x = np.floor(x * 3e6)
        x[50:90] = x[50]
        x[200:230] = x[50]
    else:
        x /= np.sqrt((x**2).sum(1))[:, None]
        x[:300] *= 1.0 if case == "one length" else 1.5
    x = x.astype(np.float64)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in norm_buckets.top_k(df, norm_buckets.every_nth(df), bucket_rows=40, block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = [[int(v) for v in r] for r in np.floor(64 * x).tolist()]
    assert got == {i: _best_of(q, i) for i in range(0, 500, 20)}


def test_top_k_of_repeated_ids_sql(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)) * np.exp(rng.normal(size=(300, 1)))
    df = _vectors(spark, [(i % 110, [float(v) for v in r], 0) for i, r in enumerate(x)])
    _same(norm_buckets.top_k(df, norm_buckets.every_nth(df), bucket_rows=40, block=7), norm_buckets.ORACLE, embeddings=df)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [0.5, 0.5], 0), (6, [0.0, 0.0], 0), (None, [9.0, 9.0], 0), (20, [-1.0, 1.0], 0)]
    df = _vectors(spark, rows)
    got = [tuple(r) for r in norm_buckets.top_k(df, norm_buckets.every_nth(df)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 6144), (0, 2, 20, 4096), (0, 3, 6, 0), (20, 1, 0, 4096), (20, 2, 5, 0), (20, 3, 6, 0)]
    assert norm_buckets.top_k(df.limit(0), df.limit(0)).count() == 0


def test_mixture_sql_and_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), None, None if s == 3 else f"s{s}", 7) for i, s in enumerate(rng.choice(6, 1500, p=[0.5, 0.2, 0.1, 0.1, 0.09, 0.01]).tolist())]
    docs = spark.createDataFrame([*rows, (9999, None, None, "empty", 7)], "doc_id long, text string, lang string, source string, size int")
    _same(mixture.mixture(docs), mixture.ORACLE, documents=docs)
    got = mixture.mixture(docs).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    by = docs.select("doc_id", "source").toPandas().merge(got, on="doc_id").groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "max"), all=("source_size", "first"))
    assert (by["target"] <= 3 * by["all"] + 1e-9).all() and abs(by["target"].sum() - by["all"].sum()) < 1e-6 * by["all"].sum()
    assert (abs(by["taken"] - by["target"]) <= 2 * by["size"]).all()
    copies = mixture.mixed(docs)
    assert copies.columns == docs.columns
    assert mixture.mixture(docs.limit(0)).count() == 0


def test_mixture_odd_rows(odd_docs):
    _same(mixture.mixture(odd_docs), mixture.ORACLE, documents=odd_docs)
