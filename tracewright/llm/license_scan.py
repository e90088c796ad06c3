"""License scans by ordered signature rules, in DataFrame functions alone.

A cheap test of the raw text lets most documents pass at once.  The others become one string of words, " w1  w2 ", on which
a rule's keyword is looked for first and its regex only then; its matches give intervals of words.  Suppression: in the order
of (start, longer first, higher priority, rule) an interval inside an earlier one of the same or a higher priority falls.
The base phrases are counted apart and their labels always stay.  The work on a text grows with its length and, by a sort, with its matches.

Null and empty texts: 0 words, no labels, score 0.  Repeated rows: one result each.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from .license_rules import BASE, CONFIDENCE, GATE, signatures

MARK = "\x01"  # no word holds it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words once A-Z are lower-case, words as they come, and what stands between them.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _gate() -> str:
    """GATE as a regex over raw text behind a space, by first letters, so that most words cost one comparison or two."""
    part = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    spell = lambda w: "".join(part + "+" if c == "_" else f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    by_first = {c: [w for w in GATE if w[0] == c] for c in sorted({w[0] for w in GATE})}
    return part + "(?:" + "|".join(spell(c) + "(?:" + "|".join(spell(w[1:]) for w in ws) + ")" for c, ws in by_first.items()) + ")"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ ]+")).cast("long")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rules = F.array(
        *[F.struct(F.lit(s.order).alias("order"), F.lit(s.label).alias("label"), F.lit(s.keyword).alias("keyword"), F.lit(s.priority).alias("priority"), F.lit(s.regex).alias("regex")) for s in signatures()]
    )
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(F.concat(F.lit(" "), "text").rlike(_gate()), F.col("text")).alias("text"))
    joined = F.regexp_replace(F.translate("text", UPPER, LOWER), BETWEEN, "  ")
    d = d.select("doc_id", "n_words", F.concat(F.lit(" "), F.regexp_replace(joined, "^  |  $", ""), F.lit(" ")).alias("norm"))

    def intervals(r: Column) -> Column:
        # marks before and after every match; the places of the marks among the words are the intervals, whatever their number
        marked = F.split(F.regexp_replace(F.col("norm"), r["regex"], F.lit(f" {MARK}$0{MARK} ")), F.lit(" +"), -1)
        places = F.array_compact(F.transform(marked, lambda w, i: F.when(w == MARK, i)))
        bounds = F.transform(places, lambda at, i: (at - 1 - i).cast("long"))  # an empty piece stands first, i marks before this one

        def pairs(b: Column) -> Column:
            one = lambda i: F.struct(F.get(b, i).alias("start"), (-F.get(b, i + 1)).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["order"].alias("order"), r["label"].alias("label"))
            return F.transform(F.sequence(F.lit(0), F.size(b) - 2, F.lit(2)), one)

        return let(bounds, pairs)

    matching = F.filter(rules, lambda r: F.contains(F.col("norm"), r["keyword"]) & F.rlike(F.col("norm"), r["regex"]))
    d = d.select("*", F.when(F.col("norm").isNotNull(), matching).alias("rules"))
    d = d.select("*", F.array_sort(F.flatten(F.transform("rules", intervals))).alias("hits"))

    def step(acc: Column, h: Column) -> Column:
        end, priority = -h["minus_end"], -h["minus_priority"]
        inside = F.when(priority == 3, acc["e3"] >= end).when(priority == 2, (acc["e3"] >= end) | (acc["e2"] >= end)).otherwise((acc["e3"] >= end) | (acc["e2"] >= end) | (acc["e1"] >= end))
        return F.struct(
            *[F.when(priority == p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in (3, 2, 1)],
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(h["label"]))).alias("labels"),
            F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], priority)).alias("best"),
        )

    start = F.struct(*[F.lit(-1).cast("long").alias(f"e{p}") for p in (3, 2, 1)], F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))
    d = d.select("doc_id", "n_words", "norm", F.when(F.size("hits") > 0, F.aggregate("hits", start, step)).alias("found"))

    norm = F.col("norm")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        p = " " + phrase.replace(" ", "  ") + " "
        n = ((F.length(norm) - F.length(F.replace(norm, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("long")
        counts.append(n)
        firsts.append(F.when(n > 0, _words(F.substring_index(norm, p, 1))))
        lasts.append(F.when(n > 0, F.col("n_words") - _words(F.substring_index(norm, p, -1)) - F.lit(len(phrase.split()))))
        labels.append(F.when(n > 0, F.lit(label)))
    null = F.lit(None).cast("long")
    base = F.array_sort(F.array_compact(F.array(*labels)))
    d = d.select(
        "doc_id",
        "n_words",
        F.coalesce(sum(counts[1:], counts[0]), F.lit(0).cast("long")).alias("n_base"),
        F.least(*firsts, null).alias("first_word"),
        F.greatest(*lasts, null).alias("last_word"),
        base.alias("base"),
        F.coalesce(F.col("found.labels"), F.array().cast("array<string>")).alias("more"),
        F.coalesce(F.col("found.best"), F.lit(0)).alias("best"),
    )
    best = F.greatest(F.col("best"), F.when(F.col("n_base") > 0, 1).otherwise(0))
    score = F.element_at(F.create_map(*[F.lit(x) for pair in ({0: 0.0} | CONFIDENCE).items() for x in pair]), best)
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"), score.alias("score"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({s.order}, {quote(s.label)}, {quote(s.keyword)}, {s.priority}, {quote(s.regex)})" for s in signatures())
    base = ", ".join(f"({quote(' ' + p.replace(' ', '  ') + ' ')}, {quote(x)}, {len(p.split())})" for p, x in BASE.items())
    count = "len(regexp_extract_all({}, '[^ ]+'))"
    return rf"""
WITH rules(ord, label, keyword, priority, rx) AS (VALUES {rules}),
base(phrase, label, size) AS (VALUES {base}),
d AS (
  SELECT doc_id, row_number() OVER () AS row,
         ' ' || regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}', '  ', 'g'), '^  |  $', '', 'g') || ' ' AS norm
  FROM documents),
m AS (
  SELECT row, ord, label, priority, string_split_regex(norm, rx) AS pieces, regexp_extract_all(norm, rx) AS found
  FROM d JOIN rules ON contains(norm, keyword) AND regexp_matches(norm, rx)),
u AS (
  SELECT row, ord, label, priority, i, {count.format('pieces[i]')} AS gap, {count.format('found[i]')} AS size
  FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM m)),
h AS (
  SELECT *, sum(gap + size) OVER (PARTITION BY row, ord ORDER BY i) AS stop,
         sum(gap + size) OVER (PARTITION BY row, ord ORDER BY i) - size AS start FROM u),
k AS (
  SELECT DISTINCT row, label, priority FROM h
  WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.row = h.row AND g.start <= h.start AND g.stop >= h.stop AND g.priority >= h.priority
    AND (g.priority > h.priority OR g.start < h.start OR g.stop > h.stop OR g.ord < h.ord))),
b AS (
  SELECT row, label, (length(norm) - length(replace(norm, phrase, ''))) / length(phrase) AS n,
         {count.format('split_part(norm, phrase, 1)')} AS first_word,
         {count.format('norm')} - {count.format('split_part(norm, phrase, -1)')} - size AS last_word
  FROM d JOIN base ON contains(norm, phrase)),
bs AS (SELECT row, sum(n)::BIGINT AS n_base, min(first_word)::BIGINT AS first_word, max(last_word)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY row),
ls AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM k UNION SELECT row, label FROM b) GROUP BY row),
sc AS (SELECT row, max(CASE priority WHEN 3 THEN 1.0 WHEN 2 THEN 0.9 ELSE 0.75 END) AS score FROM (SELECT row, priority FROM k UNION ALL SELECT row, 1 FROM b) GROUP BY row)
SELECT doc_id, {count.format('norm')}::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN bs USING (row) LEFT JOIN ls USING (row) LEFT JOIN sc USING (row)
"""
