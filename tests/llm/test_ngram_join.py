"""The Jaccard join against all pairs, on planted groups and random texts."""

import random
import re
from collections import defaultdict

import pytest

from tracewright.llm.ngram_join import one_of_each, shingle_set, similarity_components


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[top(i)])) for i in range(len(rows)))


def planted(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([2, 8, 30, 120, 300]))] + (passage if rnd.random() < 0.4 else [])
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                i = rnd.randrange(len(w))
                w[i : i + rnd.choice([0, 1])] = [word()] * rnd.choice([0, 1])
                w = w or ["x"]
            rows.append((n, (" " if rnd.random() < 0.9 else " \n").join(w).replace("the", "The", 1)))
            n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_components(spark, seed, size, percent):
    rows = planted(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similarity_components(docs, size, percent).collect())
    want = brute(rows, size, percent)
    assert got == want
    assert len({c for *_, c in want}) < len(want)


@pytest.mark.parametrize("few", [0, 2, 32])
def test_members_of_hubs(spark, monkeypatch, few):
    """Lists of differences are made for hubs of more than FEW members alone, and either way gives all links."""
    from tracewright.llm import ngram_join

    made = []
    plain = ngram_join._differences

    def spied(*given):
        out = plain(*given)
        made.append(out.where("head IS NOT NULL").count())
        return out

    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "_differences", spied)
    rows = planted(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similarity_components(docs, 5, 80).collect())
    assert got == brute(rows, 5, 80)
    assert made[0] > 0 if few == 0 else made[0] == 0 if few == 32 else True


def test_rows_without_doc_id_bridge(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[a : a + 200]) for a in (0, 16, 32)]  # neighbours share 182 of 214 shingles, the outer ones 166 of 230
    rows = [(1, texts[0]), (None, texts[1]), (3, texts[2]), (None, texts[1]), (5, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in similarity_components(docs, 3, 80).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (3, 1), (5, 5)]
    assert sorted(r["doc_id"] for r in one_of_each(docs, 3, 80).collect()) == [1, 5]
    nameless = docs.where("doc_id IS NULL")
    assert one_of_each(nameless, 3, 80).count() == 1


def test_odd_rows(odd_docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in similarity_components(odd_docs, 3, 90).collect()), key=str)
    assert (False, 2, 0, 2) in got and (False, 3, 0, 3) in got and (False, 7, 0, 7) in got
    assert got.count((False, 5, len(shingle_set("  two  spaces \n\n and\ttabs\x00 here ", 3)), 5)) == 2
    assert (False, 4, 1, 4) in got and len(got) == 10
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "None"])
    assert similarity_components(odd_docs.limit(0), 3, 90).count() == 0


def test_tables_are_dropped_and_the_setting_comes_back(spark, tmp_path):
    from tracewright.llm.common import SHUFFLES_END, Tables

    before = spark.conf.get(SHUFFLES_END, None)
    tables = Tables(spark)
    tables.folder = f"file://{tmp_path}/t"
    assert tables.keep("a", spark.range(3).groupBy("id").count()).count() == 3
    tables.keep("b", spark.range(2))
    assert spark.conf.get(SHUFFLES_END, None) == before
    tables.drop("a")
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")] == ["b"]
    tables.drop_all()
    assert not (tmp_path / "t").exists()


def test_shared_values_end_with_their_tables(spark):
    from tracewright.llm.common import Tables

    tables = Tables(spark)
    value = tables.share(list(range(10)))
    assert spark.range(3).rdd.map(lambda r: value.value[r.id]).sum() == 3
    tables.drop_all()
    assert tables.shared == []
    with pytest.raises(Exception, match="destroyed"):
        spark.range(3).rdd.map(lambda r: value.value[r.id]).sum()


def test_no_table_or_shuffle_outlives_its_last_reader(spark, tmp_path):
    import time
    from pathlib import Path

    from tracewright.llm.common import Tables
    from tracewright.llm.ngram_join import _levels, _read

    beside = {}

    class Watched(Tables):
        def keep(self, name, df):
            beside[name] = {p.name for p in Path(self.folder.removeprefix("file://")).glob("*")}
            return super().keep(name, df)

    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(3, 40)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = similarity_components(docs, 3, 90, Watched(spark))
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == sorted((d, c) for d, _, c in brute(rows, 3, 90))
    assert beside["lists"] == {"rows"}  # the tables of counts are gone
    assert "placed" in beside["members"] and "placed" not in beside["diffs"]

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while files.hasNext():
            names.add(files.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    read = Tables(spark).keep("read", _read(docs, 3))
    before = shuffled()
    assert _levels(read).any()
    for _ in range(30):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before


def test_chance_meetings_cost_no_sets(spark):
    """Texts that share passages with several others, and link with none, are told apart by counts; differences from hubs are not written."""
    from tracewright.llm.common import Tables

    made = {}

    class Watched(Tables):
        def keep(self, name, df):
            out = super().keep(name, df)
            made[name] = out.count()
            return out

    rnd = random.Random(6)
    passages = [[f"p{k}w{i}" for i in range(100)] for k in range(100)]
    rows = [(d, " ".join(w for p in rnd.sample(passages, 10) for w in p)) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similarity_components(docs, 3, 90, Watched(spark)).collect())
    assert got == brute(rows, 3, 90)
    assert len({c for *_, c in got}) == 40
    assert made["shared"] > 0 and made["diffs"] == 0


def test_entries_stay_beside_fitting_sizes_alone(spark):
    from tracewright.llm.ngram_join import _open_parts, _shared

    rows = [(1, 10, 100, 0), (1, 11, 91, 0), (1, 11, 91, 0), (1, 12, 80, 0), (2, 20, 50, 0), (2, 20, 50, 0), (3, 30, 9, 5), (4, 40, 90, 0), (4, 41, 100, 0), (4, 42, 101, 0)]
    lists = spark.createDataFrame([(s, v, n, 0, salt) for s, v, n, salt in rows], "shingle long, v long, n int, score int, salt int")
    shared = _shared(lists, 90)
    assert sorted((r["shingle"], r["v"]) for r in shared.collect()) == [(1, 10), (1, 11), (3, 30), (4, 40), (4, 41), (4, 42)]
    placed = spark.createDataFrame([(s, v, n, 0, c) for s, v, n, c in [(7, 1, 90, 1), (7, 2, 100, 2), (8, 3, 90, 3), (8, 4, 120, 4), (9, 5, 60, 5), (9, 6, 60, 5)]], "shingle long, v long, n int, score int, c long")
    parts = [(r["shingle"], r["part"], r["v"]) for r in _open_parts(placed, 90).collect()]
    assert {(s, v) for s, _, v in parts} == {(7, 1), (7, 2)}
    assert {p for _, p, v in parts if v == 1} == {p for _, p, v in parts if v == 2}
