"""Quality rules: counts of the text itself, and its distance from language references.

References: over all documents that pass the base rules, for each language, the histogram of character classes and that of
its common short words.  Whether a language's reference counts is seen from its own documents alone, whatever its script and its share of
the corpus: short words made of letters that recur over many of
them make up a part of what they say.  So junk under a tag of its own is no reference for itself, however much of
it there is.  Verdict of the method: the Jensen-Shannon divergences (base 2, 0 to 1) of a document's two histograms from one
and the same reference, the nearest by both together; above the limit on either one the document is not kept.  Documents
below a minimum length have too few words for a histogram, and languages with few documents have no reference to be held against; both
are judged by the counts alone, unless another reference is near.

A document is compared with the `most_languages` largest references that count and with that of its own language.  The former are a small
model; a language beyond them brings its reference by a shuffle join.  The definition is one and the same.

Words of scripts that put no spaces between them count character by character in the histograms.
Null text: no words.  Null lang: a language of its own.  Repeated rows: one result each.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    least_words: int = 20  # fewer fail
    most_repeated_percent: int = 30  # of the words, in repeated windows
    histogram_words: int = 50  # fewer have no histogram of their own
    most_class_divergence: float = 0.10
    most_word_divergence: float = 0.22
    common_share: float = 0.003  # of its language's words; so at most 333 words a language are common
    short: int = 6  # characters of a word that may be a common one
    most_languages: int = 256
    least_documents: int = 20  # of a language that is to have a reference
    recurring: float = 0.05  # of its language's documents hold a word that recurs
    least_common: float = 0.1  # of a language's words are common ones that recur and are made of letters
    held_words: int = 200_000  # distinct words a task counts before it hands the counts on


N_CLASSES = 8


@cache
def _classes() -> np.ndarray:
    """Character class by code point: small letters and marks on them, capitals, letters without case, digits, white space, common signs, other signs, all else."""
    import unicodedata

    kinds = {"Ll": 0, "Mn": 0, "Mc": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4}
    table = np.array([kinds.get(kind, 6 if kind[0] == "P" else 7) for kind in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
    table[[ord(c) for c in " \t\n\r\v\f"]] = 4
    table[[ord(c) for c in ".,;:?'\"-()。、，"]] = 5
    return table


def class_counts(text: str) -> np.ndarray:
    return np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=N_CLASSES)


def base_counts(words: list[bytes], limits: Limits) -> tuple[int, bool]:
    """n_repeat_words and base_failed."""
    repeated = repeated_words(words)
    return repeated, len(words) < limits.least_words or 100 * repeated > limits.most_repeated_percent * len(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of 8 that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29)))
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(mixed, twice)).tolist()
    seen = Counter(tuple(words[i : i + WINDOW]) for i in starts)  # the words themselves decide
    starts = [i for i in starts if seen[tuple(words[i : i + WINDOW])] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, [i + WINDOW for i in starts], -1)
    return int((np.cumsum(edge) > 0).sum())


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of p from every row of q, in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.clip((a + b) / 2, 0.0, 1.0)


#: Blocks of scripts that put no spaces between words (Thai and Lao, Burmese, Khmer, kana, Han).
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")


def tokens(text: str, words: list[bytes], limits: Limits) -> list[bytes]:
    """The words in small letters; longer ones of scripts without spaces as their characters."""
    low = [w.lower() for w in words]
    if text.isascii() or not UNSPACED.search(text):
        return low
    out = []
    for w in low:
        told = w.decode()
        out += [c.encode() for c in told] if len(told) > limits.short and UNSPACED.search(told) else [w]
    return out


#: Words of signs alone; they are one cell of every word histogram, so that texts full of them are near no language.
SIGNS = re.compile(r"(?<![^\x20\x09-\x0D])[^\w\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")


def is_short(token: bytes, limits: Limits) -> bool:
    return len(token) <= limits.short or len(token) <= 4 * limits.short and not token.isascii() and len(token.decode()) <= limits.short


def of_letters(token: bytes) -> bool:
    return bool(token) and int(_classes()[np.frombuffer(token.decode().encode("utf-32-le"), "<u4")].max()) <= 2


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray  # shares
    words: list[bytes]
    shares: np.ndarray  # of `words`, then of words of signs alone, then of all others

    @classmethod
    def of(cls, row: dict) -> "Reference":
        classes = np.array(row["classes"], float)
        words = sorted((bytes(r["word"]), r["n"]) for r in row["words"] or ())
        shares = np.array([n for _, n in words] + [row["signs"], row["n"] - row["signs"] - sum(n for _, n in words)], float)
        return cls(classes / max(classes.sum(), 1), [w for w, _ in words], shares / max(row["n"], 1))

    def word_divergence(self, counts: dict[bytes, int], signs: int, n: int) -> float:
        own = np.array([counts.get(w, 0) for w in self.words] + [signs, 0], float)
        own[-1] = n - own.sum()
        return float(divergence(own / n, self.shares[None])[0])


@dataclass(frozen=True)
class References:
    langs: dict[str, bool]  # of the largest languages: whether one is too small for a reference
    known: list[Reference]  # those of them that count
    classes: np.ndarray  # of `known`
    rest: DataFrame | None = None  # lang, counts, small and reference of every other language, if there are any


def references(docs: DataFrame, limits: Limits = Limits()) -> References:
    """Histograms by language over all documents that pass the base rules."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict[str, Counter] = defaultdict(Counter)
        held: dict[str, Counter] = defaultdict(Counter)  # documents that hold a word
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES, np.int64))
        totals: Counter = Counter()
        documents: Counter = Counter()
        signs: Counter = Counter()
        schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("d", pa.int64()), ("s", pa.int64()), ("classes", pa.list_(pa.int64()))])

        def handed_on():
            for lang, c in counts.items():
                words = list(c)
                for a in range(0, len(words), 50_000):
                    some = words[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array([c[w] for w in some], pa.int64()), pa.array([held[lang][w] for w in some], pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.list_(pa.int64()))], schema=schema)
            counts.clear()
            held.clear()

        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[i].as_py()
                words = text.encode().split()
                if base_counts(words, limits)[1]:
                    continue
                every = tokens(text, words, limits)
                mine = Counter([w for w in every if len(w) <= limits.short or is_short(w, limits)])
                totals[lang] += len(every)
                documents[lang] += 1
                signs[lang] += len(SIGNS.findall(text))
                counts[lang].update(mine)
                held[lang].update(mine.keys())
                classes[lang] += class_counts(text)
            if sum(map(len, counts.values())) > limits.held_words:
                yield from handed_on()
        yield from handed_on()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.binary()), pa.array(list(totals.values()), pa.int64()), pa.array([documents[x] for x in totals], pa.int64()), pa.array([signs[x] for x in totals], pa.int64()), pa.array([classes[x].tolist() for x in totals], pa.list_(pa.int64()))], schema=schema)

    small_batches(docs.sparkSession)
    pick = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    part = pick.mapInArrow(run, "lang string, word binary, n long, d long, s long, classes array<long>")
    # word null is the language itself, with all its words and documents and its classes
    sums = stored(part.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("s").alias("s"), *[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(N_CLASSES)]))
    every = _by_language(sums, limits)
    largest = every.orderBy(F.desc("n"), "lang").limit(limits.most_languages + 1).collect()
    more, largest = len(largest) > limits.most_languages, largest[: limits.most_languages]
    known = [Reference.of(r["reference"].asDict()) for r in largest if r["counts"]]
    langs = {r["lang"]: r["small"] for r in largest}
    rest = every.where(~F.col("lang").isin(list(langs))).select("lang", "counts", "small", "reference") if more else None
    return References(langs, known, np.array([r.classes for r in known]).reshape(-1, N_CLASSES), rest)


def _by_language(sums: DataFrame, limits: Limits) -> DataFrame:
    """lang, n, counts, small, reference (n, signs, classes, its common words, 333 at most) of every language."""
    letters, signs = (F.udf(f, "boolean") for f in (lambda w: of_letters(bytes(w)), lambda w: bool(SIGNS.fullmatch(bytes(w).decode()))))  # on common words alone
    classes = F.array(*[f"c{k}" for k in range(N_CLASSES)])
    whole = sums.where("word IS NULL").select("lang", F.col("n").alias("total"), F.col("d").alias("documents"), F.col("s").alias("signs"), classes.alias("classes"))
    common = sums.where("word IS NOT NULL").join(whole.select("lang", "total", "documents"), "lang").where(F.col("n") >= F.greatest(F.lit(1.0), F.col("total") * limits.common_share)).where(~signs("word"))
    recurring = letters("word") & (F.col("d") >= F.col("documents") * limits.recurring)
    words = common.groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("words"), F.sum(F.when(recurring, F.col("n"))).alias("lettered"))
    d = whole.join(words, "lang", "left")
    small = F.col("documents") < limits.least_documents
    counts = ~small & (F.coalesce("lettered", F.lit(0)) >= limits.least_common * F.col("total"))
    return d.select("lang", F.col("total").alias("n"), counts.alias("counts"), small.alias("small"), F.struct(F.col("total").alias("n"), "signs", "classes", "words").alias("reference"))


def _with_own(docs: DataFrame, ref: References) -> DataFrame:
    """docs; with languages beyond the model's, one column more at the end: (small, reference) of such a document's language."""
    if ref.rest is None:
        return docs
    name = "_reference"
    while name in docs.columns:
        name += "_"
    key = F.coalesce(docs["lang"].cast("string"), F.lit(""))
    rest = ref.rest.select(F.col("lang").alias(name + "lang"), F.struct("counts", "small", "reference").alias(name))
    first = key.isin(list(ref.langs))
    far = docs.where(~first).join(rest, key == rest[name + "lang"], "left").select(*[docs[c] for c in docs.columns], rest[name])
    return docs.where(first).withColumn(name, F.lit(None).cast(rest.schema[name].dataType)).union(far)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_divergence double, word_divergence double"


def nearest(classes: np.ndarray, counts: dict[bytes, int], signs: int, n: int, ref: References, own: Reference | None, limits: Limits) -> tuple[float, float] | None:
    """Both divergences from the reference where the larger of them, each by its limit, is the least."""
    found = list(zip(divergence(classes, ref.classes).tolist(), ref.known, strict=True)) if ref.known else []
    if own:
        found.append((float(divergence(classes, own.classes[None])[0]), own))
    best, least = None, np.inf
    for by_class, r in sorted(found, key=lambda x: x[0]):
        if by_class / limits.most_class_divergence >= least:
            break  # no later one can be nearer
        by_word = r.word_divergence(counts, signs, n)
        far = max(by_class / limits.most_class_divergence, by_word / limits.most_word_divergence)
        if far < least:
            best, least = (by_class, by_word), far
    return best


def judge(text: str, lang: str, ref: References, limits: Limits, mine: dict | None = None) -> tuple:
    data = text.encode()
    words = data.split()  # the six ASCII white-space bytes
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\r\v\f")
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated, failed = base_counts(words, limits)
    by_class = by_word = None
    kept = not failed
    if n >= limits.histogram_words:
        classes = class_counts(text)
        every = tokens(text, words, limits)
        own = Reference.of(mine["reference"]) if mine and mine["counts"] else None
        near = nearest(classes / classes.sum(), Counter(every), len(SIGNS.findall(text)), len(every), ref, own, limits)
        if near:
            by_class, by_word = near
        small = mine["small"] if mine else ref.langs.get(lang, True)
        inside = near is not None and by_class <= limits.most_class_divergence and by_word <= limits.most_word_divergence
        kept = kept and (inside or small)
    return n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, failed, kept, by_class, by_word


def _own(batch, at: int) -> list | repeat:
    """The column that _with_own may have put at this place."""
    return batch.column(at).to_pylist() if batch.num_columns > at else repeat(None)


def quality_rules(docs: DataFrame, limits: Limits = Limits(), ref: References | None = None) -> DataFrame:
    """Per document the counts, base_failed, kept and the two divergences."""
    ref = ref or references(docs, limits)
    width = len(docs.columns)
    docs, ref = _with_own(docs, ref), replace(ref, rest=None)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            cols = list(zip(*(judge(t.as_py(), lang, ref, limits, own) for t, lang, own in zip(batch.column(1), batch.column(2).to_pylist(), _own(batch, 3))), strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), *docs.columns[width:])
    return pick.mapInArrow(run, COLUMNS)


def without_rejected(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that are kept, all columns as they are."""
    ref = references(docs, limits)
    at, lang_at, width, schema = docs.columns.index("text"), docs.columns.index("lang"), len(docs.columns), docs.schema
    docs, ref = _with_own(docs, ref), replace(ref, rest=None)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept = [judge(t.as_py() or "", str(lang if lang is not None else ""), ref, limits, own)[6] for t, lang, own in zip(batch.column(at), batch.column(lang_at).to_pylist(), _own(batch, width))]
            yield batch.select(list(range(width))).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)
