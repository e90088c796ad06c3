"""Quality rules against plain Python; held-out accuracy of the classifiers; the pipeline."""

import math
import pickle
import random
import re
import tracemalloc
from collections import Counter
from hashlib import md5
from zlib import crc32

import numpy as np
import pytest

from tracewright.llm.quality_classifier import SHAPE, SubwordClassifier, features, score_quality
from tracewright.llm.quality_rules import Limits, class_counts, quality_rules, references, repeated_words, without_rejected
from tracewright.llm.toxicity import NearestExamples, score_toxicity, without_copies, without_toxic

SF = "/root/testdata/sf0.1"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def test_quality_counts(odd_docs):
    rnd = random.Random(4)
    more = [(100 + i, " ".join(rnd.choice(["a", "b", "#x", "é|"]) for _ in range(rnd.randint(1, 60))) + "\nsame\nsame\n \n", "en", "a", 7) for i in range(40)]
    docs = odd_docs.unionByName(odd_docs.sparkSession.createDataFrame(more, odd_docs.schema))
    got = sorted((tuple(r)[:7] for r in quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert got == sorted(((r["doc_id"], *plain_counts(r["text"])) for r in docs.collect()), key=str)
    assert not quality_rules(docs).where("base_failed AND kept").count()
    assert without_rejected(docs).columns == docs.columns
    assert quality_rules(docs.limit(0)).count() == 0


def test_repeated_words_need_equal_words():
    assert repeated_words([b"x"] * 9) == 9
    assert repeated_words([b"%d" % i for i in range(50)]) == 0


def test_quality_verdict_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    d = quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").where("n_words >= 50 AND NOT base_failed").toPandas()
    assert d[d.quality == 1].kept.mean() > 0.99
    assert d[d.quality == 0].kept.mean() < 0.2


@pytest.mark.parametrize("times", [1, 12])
def test_junk_under_a_tag_of_its_own(spark, times):
    """However much of it there is: at 12 times some two fifths of all characters."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    poor = labels.where("quality = 0").selectExpr("doc_id", "'zz' AS tag")
    docs = docs.join(poor, "doc_id", "left").selectExpr("doc_id", "text", "coalesce(tag, lang) AS lang", f"if(tag = 'zz', {times}, 1) AS times")
    docs = docs.selectExpr("doc_id", "text", "lang", "explode(sequence(1, times)) AS nth").drop("nth")
    judged = quality_rules(docs).where("n_words >= 50 AND NOT base_failed").join(docs.where("lang = 'zz'").select("doc_id").distinct(), "doc_id").toPandas()
    assert len(judged) > 100 * times and judged.kept.mean() < 0.05


def prose(lang, letters, n, first, word=(2, 7), space=" "):
    """Invented prose: common words and rarer ones, sentences and lines."""
    rnd = random.Random(lang)
    make = lambda a, b: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, b)))
    common, rare = [make(1, 3) for _ in range(30)], [make(*word) for _ in range(4000)]
    return [(first + i, "".join((rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(rare)) + (".\n" if j % 13 == 12 else ", " if j % 7 == 6 else space) for j in range(rnd.randint(300, 600))), lang) for i in range(n)]


def test_small_languages_of_every_script_are_kept(spark):
    """Scripts without case and without spaces, each some hundredth of the corpus; and a language of three documents, which has no reference."""
    han = [chr(0x4E00 + i) for i in range(400)]
    few = [
        *prose("ar", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", 40, 10**6), *prose("he", "אבגדהוזחטיכלמנסעפצקרשת", 40, 10**6 + 100), *prose("ko", [chr(0xAC00 + 28 * i) for i in range(300)], 40, 10**6 + 200, (2, 4)),
        *prose("hi", "कखगघचछजझटठडढणतथदधनपफबभमयरलवाीूेो", 40, 10**6 + 300), *prose("zh", han, 40, 10**6 + 400, (1, 2), ""), *prose("ka", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", 3, 10**6 + 500),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame(few, "doc_id long, text string, lang string"))
    got = quality_rules(docs).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id >= 1000000 AND NOT base_failed").toPandas().groupby("lang").kept
    assert set(got.groups) == {"ar", "he", "ko", "hi", "zh", "ka"}
    assert (got.mean() > 0.95).all() and (got.count()[["ar", "he", "ko", "hi", "zh"]] > 30).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    poor = quality_rules(docs).join(labels.where("quality = 0"), "doc_id").where("n_words >= 50 AND NOT base_failed").toPandas()
    assert poor.kept.mean() < 0.05  # nor does a reference of another script let them in


def test_classes_of_every_script():
    for text, place in (("привет", 0), ("ПРИВЕТ", 1), ("日本語", 2), ("٣٤", 3), ("\u2003 ", 4), ("?。", 5), ("«»", 6), ("$€", 7)):
        assert class_counts(text)[place] == len(text)


def plain_divergence(p, q):
    keys = p.keys() | q.keys()
    mean = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in keys}
    return sum(x.get(k, 0) * math.log2(x[k] / mean[k]) for x in (p, q) for k in keys if x.get(k)) / 2


def test_verdict_against_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").collect()
    share = lambda c: {k: n / sum(c.values()) for k, n in c.items()}
    classes = lambda t: Counter(dict(enumerate(class_counts(t).tolist())))
    by_lang, letters = {}, {}
    signs = lambda w: not re.search(r"\w", w.decode())
    words_of = lambda t: Counter("signs" if signs(w) else w.lower() for w in t.encode().split())
    for r in rows:
        if not plain_counts(r["text"])[5]:
            by_lang.setdefault(r["lang"], Counter()).update(words_of(r["text"] or ""))
            letters.setdefault(r["lang"], Counter()).update(classes(r["text"] or ""))
    common = lambda c: {w for w, n in c.items() if w != "signs" and len(w.decode()) <= 6 and n >= max(1, 0.003 * sum(c.values()))}
    mine = {lang: common(c) | {"signs"} for lang, c in by_lang.items()}
    some = lambda c, known: share(Counter({k: c[k] for k in known if c[k]} | {None: sum(c.values()) - sum(c[k] for k in known)}))
    got = {r["doc_id"]: r for r in quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    wrong = 0
    for r in rows:
        n, *_, failed = plain_counts(r["text"])
        kept = not failed
        if n >= 50:
            own, words = share(classes(r["text"])), words_of(r["text"])
            pairs = [(plain_divergence(own, share(letters[x])), plain_divergence(some(words, mine[x]), some(by_lang[x], mine[x]))) for x in by_lang]
            best = min(pairs, key=lambda p: max(p[0] / 0.10, p[1] / 0.22))
            kept = kept and best[0] <= 0.10 and best[1] <= 0.22
            assert got[r["doc_id"]].word_divergence == pytest.approx(best[1], abs=1e-9)
        wrong += kept != got[r["doc_id"]].kept
    assert not wrong


def test_languages_beyond_the_model_have_their_own_reference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg({"text": "count"}).toDF("lang", "n").collect()}
    few = Limits(most_languages=len(sizes) - 1)
    verdicts = lambda limits: {r["doc_id"]: r for r in quality_rules(docs, limits).collect()}
    want, got = verdicts(Limits()), verdicts(few)
    assert len(want) == len(got) == docs.count()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    (left_out,) = set(sizes) - set(references(docs, few).langs)
    mine = [d for d in want if lang[d] == left_out]
    assert len(mine) > 50 and all(want[d] == got[d] for d in mine)
    kept = without_rejected(docs, few)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d in got if got[d].kept}


def _split(spark, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").orderBy("doc_id").select("doc_id", "text", label).collect()
    out = lambda r: crc32(str(r["doc_id"]).encode()) % 5 == 0
    picked = sorted((r for r in rows if not out(r)), key=lambda r: md5(str(r["doc_id"]).encode()).hexdigest())  # as examples() picks
    train = [(r["text"], r[label]) for r in picked]
    return train, [(r["text"], r[label]) for r in rows if out(r)], sum(y for _, y in train) / len(train)


@pytest.mark.parametrize("kind,label,threshold,most", [(NearestExamples, "toxic", 0.5, 2000), (SubwordClassifier, "quality", 0.3, 2000)])
def test_held_out_accuracy(spark, kind, label, threshold, most):
    train, test, share = _split(spark, label)
    small = [r for y in (0, 1) for r in [r for r in train if r[1] == y][:most]]
    model = kind(small, share)
    score = lambda t: model.score([t])[0][0] if kind is NearestExamples else model.score(t)
    marked = [(score(t) >= threshold, bool(y)) for t, y in test]
    assert sum(m == y for m, y in marked) / len(marked) > 0.97
    rare = label == "toxic"  # the class that is looked for: toxic ones, poor ones
    assert sum(m == y for m, y in marked if y == rare) >= 0.9 * sum(y == rare for _, y in marked)
    assert sum(m != y for m, y in marked if y != rare) <= 0.01 * sum(y != rare for _, y in marked)
    assert all(0 <= score(t) <= 1 for t in ("", " ", "x" * 10_000, "日本"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxicity_of_small_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").orderBy("doc_id").collect()]
    found = wrong = 0
    for fold in range(5):  # each document is scored without being an example
        train = [r for i, r in enumerate(rows) if i % 5 != fold]
        model = NearestExamples(train, sum(y for _, y in train) / len(train))
        assert len(model.index) > 5_000  # of some 15,000 and 35,000 terms
        for text, y in rows[fold::5]:
            marked = model.score([text])[0][0] >= 0.5
            found, wrong = found + (marked and y), wrong + (marked and not y)
    toxic = sum(y for _, y in rows)
    assert found >= 0.6 * toxic and wrong <= 0.1 * (len(rows) - toxic)


def test_only_near_copies_of_kept_examples_go():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    rows = []
    for _ in range(60):  # chains of texts that change by 3 % to 50 % at each step, in both labels
        words, change = [word() for _ in range(rnd.randint(1, 60))], rnd.choice([0, 0.03, 0.1, 0.5])
        for _ in range(5):
            rows.append((" ".join(words), rnd.randint(0, 1)))
            words = [word() if rnd.random() < change else w for w in words]
    kept = []
    for text, y in rows:
        words = text.split()
        mine = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        if not any(y == z and 5 * len(mine & s) >= 4 * len(mine | s) for _, z, s in kept):
            kept.append((text, y, mine))
    assert without_copies(rows) == [k[:2] for k in kept] and len(kept) < len(rows)


def test_long_words_count_whole():
    rnd = random.Random(6)
    text = lambda signs: "段" * 20 + "".join(rnd.choices(signs, k=200))  # noqa: E731  (no white space)
    rows = [(text("好文章清楚"), 1) for _ in range(40)] + [(text("垃圾廣告買"), 0) for _ in range(40)]
    model = SubwordClassifier(rows, 0.5)
    assert all((model.score(text(signs)) > 0.5) == y for signs, y in (("好文章清楚", True), ("垃圾廣告買", False)) for _ in range(10))


def plain_features(text):
    """Bucket: weight of a text, word by word in plain Python; the hashes are those of the operator."""
    spread, full = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & full
        x = (x ^ x >> 29) * spread & full
        return x ^ x >> 32

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    out = Counter()
    for w in words:
        e = b"<" + w + b">"
        found = [sum(mix(c + (i << 8)) for i, c in enumerate(e)) & full, sum(mix(int(SHAPE[c]) + (i << 8)) * spread & full for i, c in enumerate(e)) & full]
        for n in (2, 3, 4):
            for i in range(len(e) - n + 1):
                h = e[i]
                for c in e[i + 1 : i + n]:
                    h = h * 257 + c + 1
                found.append(mix(h & full) * spread & full)
        for h in found:
            out[h >> 47] += 0.8 / len(words) / len(found)
    fresh, expected = (len(set(words)) / len(words) if words else 1.0), (1.0 if len(words) < 2 else len(words) ** -0.2)
    for own in (1 + min(12, len(words).bit_length()), 100 + min(20, int(10 * fresh / expected))):
        out[mix(own * 1_000_003) >> 47] += 0.1
    return out


def test_quality_scores_against_plain_python():
    rnd = random.Random(8)
    texts = ["", " ", "a", "Ab1 ab1\tab1\n" * 40, "x" * 700, "日本 語 é" * 9] + [" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 200))) for _ in range(20)]
    model = SubwordClassifier([(t, i % 2) for i, t in enumerate(texts)], 0.4)
    for t in texts:
        want = plain_features(t)
        assert sum(want.values()) == pytest.approx(1 if t.strip() else 0.2)
        got = Counter()
        for ids, weights in features(t, 1 << 17, 0.2):
            for i, w in zip(ids.tolist(), weights.tolist(), strict=True):
                got[i] += w
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        z = model.bias + sum(model.per_bucket[i] * w for i, w in want.items())
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-z)))


def test_nearest_are_exact(spark):
    train, test, share = _split(spark, "toxic")
    model = NearestExamples([r for r in train if r[1]][:200] + [r for r in train if not r[1]][:200], share, k=5)
    for text, _ in [r for r in test if r[1]][:30]:
        ((_, best),) = model.score([text])
        bag = Counter(t for w in re.findall(r"[^\W\d_]+", text.lower()) for t in ((w,) if len(w) <= 4 else (w, w[:4] + "*")))
        v = model._weighted(*(np.array(x) for x in zip(*sorted((model.index[t], c) for t, c in bag.items() if t in model.index), strict=True)))
        every = Counter()
        for q, t in zip(v[1], v[0], strict=True):
            for at, w in zip(model.post[t][0].tolist(), model.post[t][1].tolist(), strict=True):
                every[at] += q * w
        want = sorted(((-round(s, 9), i) for i, s in every.items()))[:5]
        assert [(-round(s, 9), i) for s, i in best] == want


def test_model_is_small_where_it_is_unpacked():
    """Postings once, in narrow numbers: some 40 bytes a posting before, matrix and names of terms aside."""
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(3000)]
    data = pickle.dumps(NearestExamples([(" ".join(rnd.choices(words, k=150)), i % 2, i) for i in range(600)], 0.5))
    tracemalloc.start()
    model = pickle.loads(data)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    postings = sum(len(model.post[t][0]) for t in range(len(model.index)))
    aside = 250 * len(model.index) + model.post.matrix.nbytes
    assert postings > 80_000
    assert held - aside < 30 * postings and peak - aside < 60 * postings, ((held - aside) / postings, (peak - aside) / postings)


def test_model_is_all_that_a_worker_holds():
    from tracewright.llm.labelled import Packed

    data = pickle.dumps(list(range(5)))
    assert pickle.loads(pickle.dumps(Packed(data))) == list(range(5))


def test_blocks_out_of_reach_are_left_out():
    rnd = random.Random(10)
    words = ["".join(rnd.choices("klmnopqrst", k=4)) for _ in range(4000)]
    rows = [(" ".join(["abc" if i < 160 else "xyz"] * 5 + rnd.choices(words, k=10)), int(i < 160), i) for i in range(1280)]  # "abc" alone tells, and in an eighth
    model = NearestExamples(rows, 0.5)
    q = model._weighted(*np.unique(np.array([model.index[w] for w in rows[70][0].split()]), return_counts=True))
    every = model.post.sums(*q)
    blocks = np.arange(model.post.blocks) % 3 == 1
    assert model.post.sums_within(blocks, *q).tolist() == np.where(np.repeat(blocks, 64)[: len(every)], every, 0).tolist()
    within, model.post.sums_within = [], lambda b, at, w, f=model.post.sums_within: (within.append(b.sum()), f(b, at, w))[1]
    (best,) = model.nearest([q])
    assert len(within) == 1 and 0 < within[0] < model.post.blocks / 4
    assert best == sorted(((s, i) for i, s in enumerate(every.tolist()) if s), key=lambda x: (-x[0], x[1]))[: model.k]


def test_examples_without_letters_score_the_share():
    assert NearestExamples([("1 2 3", 1, 1), ("4 5 6", 0, 2)], 0.25).score(["words", ""]) == [(pytest.approx(0.25), [])] * 2


def test_odd_rows(odd_docs, labels):
    for f in (score_toxicity, score_quality):
        rows = f(odd_docs, labels).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert f(odd_docs, labels.limit(0)).count() == 10
        assert f(odd_docs.limit(0), labels).count() == 0
    assert without_toxic(odd_docs, labels).columns == odd_docs.columns


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in p.run(spark, sf).collect())
    # the same decisions from each operator's own scores
    left = docs.join(score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").select("doc_id"), "doc_id")
    left = left.join(quality_rules(left).where("kept").select("doc_id"), "doc_id").toPandas()
    from test_ngram_join import brute

    first = {c for _, _, c in brute(list(zip(left.doc_id, left.text, strict=True)), 5, 80)}
    left = left[left.doc_id.isin(first)]
    from tracewright.llm.common import tokenizer_path
    from tracewright.llm.mixture import mixture

    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixture(spark.createDataFrame(left)).collect() if r["size"]}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    from hashlib import sha256

    digest = lambda t: sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest()
    assert got == sorted((d, digest(t)) for d, t in zip(left.doc_id, left.text, strict=True) for _ in range(taken.get(d, 0)))


def test_a_model_reaches_the_driver_in_small_results(spark):
    """No row and no task's result is large enough to be fetched whole; the model arrives whole all the same."""
    from tracewright.llm import labelled

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows, share = labelled.sample(docs, marks, "toxic", 20)
    model = lambda rows, share: random.Random(len(rows)).randbytes(5_000_000)
    sizes = labelled.in_pieces(rows, share, model).selectExpr("spark_partition_id() p", "length(piece) n").collect()
    by_task = Counter()
    for r in sizes:
        by_task[r["p"]] += r["n"]
    assert sum(by_task.values()) >= 5_000_000 and max(r["n"] for r in sizes) <= 1 << 17 and max(by_task.values()) < 1 << 20
    shared = labelled.fitted(docs, marks, "toxic", 20, model)
    got = spark.range(1).rdd.map(lambda _: md5(shared.value).hexdigest()).first()
    assert got == md5(model([None] * rows.count(), share)).hexdigest()
