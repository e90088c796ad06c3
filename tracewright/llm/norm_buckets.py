"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers, floor(scale * x), and ordered by length into buckets of bounded size, the longest first.
Every query first meets the top bucket, which gives it a floor: its k-th best product so far.  A bucket whose longest
vector cannot reach the floor is skipped; since buckets go by length, a query needs only the first few of them.  Inside a
bucket the local cosine threshold, floor / (query length * bucket length), decides: near 1, coordinate pruning (each
coordinate of a unit vector that reaches the threshold lies in a narrow range around the query's); otherwise length
pruning.  What is left is verified with integer products.

Work is dealt as (bucket, block of queries) groups of bounded size; nothing is broadcast but the bucket lengths, of which
there are at most `most_buckets`.  Behind the top bucket a block holds queries that reach about equally far, and a candidate
is copied to the blocks that reach its bucket alone.  The number of pairs read grows with queries times candidates within
reach, as exact search must.

Vectors that are null, or hold null or non-finite components, take no part; nor do those without vec_id, nor vectors of
another dimension than the query's (their product is not defined).  Repeated vec_ids are separate candidates.  A query meets
every row but those of its own vec_id; ties go to the smaller vec_id; a repeated query id gives one answer, the
highest products of all its rows, as in SQL.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCHEMA = "query_id long, vec_id long, score long"
NO_FLOOR = -(2**63)  # of a query that has fewer than k products yet; floors stay whole numbers, as scores may pass 2**53


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))


def bucket_top(q_ids, q_vecs, floors, c_ids, c_vecs, k: int, coordinate_from: float = 0.8) -> Iterator[tuple[int, int, int]]:
    """Top k of one bucket for each query, given floors that a product must reach to matter."""
    lengths = np.sqrt((c_vecs.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    c_ids, c_vecs, lengths = c_ids[order], c_vecs[order], lengths[order]
    unit = c_vecs / np.maximum(lengths, 1e-300)[:, None]
    exact = c_vecs.astype(np.float64)  # products below 2**53 are exact
    big = float(np.abs(c_vecs).max(initial=0)) * float(np.abs(q_vecs).max(initial=0)) * max(1, c_vecs.shape[1]) >= 2.0**53
    for q, v, floor in zip(q_ids.tolist(), q_vecs, floors.tolist(), strict=True):
        length = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
        n = len(c_ids)
        keep = None
        if length > 0 and floor is not None and floor > 0:
            need = floor * (1 - 1e-9) / length
            n = int(np.searchsorted(-lengths, -need, side="right"))  # length pruning
            cosine = need / lengths[0] if n else 2.0
            if n and cosine >= coordinate_from:
                keep = np.ones(n, bool)
                u, t = v / length, min(1.0, cosine)
                for f in np.argsort(-np.abs(u))[:3].tolist():  # the query's largest coordinates say most
                    slack = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
                    keep &= (unit[:n, f] >= u[f] * t - slack) if u[f] >= 0 else (unit[:n, f] <= u[f] * t + slack)
        if not n:
            continue
        at = np.arange(n) if keep is None else np.flatnonzero(keep)
        if big:
            scores = np.array([sum(map(mul, v.tolist(), c_vecs[i].tolist())) for i in at.tolist()], np.int64)
        else:
            scores = ((exact[:n] if keep is None else exact[at]) @ v.astype(np.float64)).astype(np.int64)
        good = c_ids[at] != q
        if floor is not None:
            good &= scores >= floor
        at, scores = at[good], scores[good]
        for i in _best(c_ids[at], scores, k).tolist():
            yield q, int(c_ids[at[i]]), int(scores[i])


def deal(counts: dict[int, int], block: int, buckets: int) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Blocks of queries that reach as far as one another.

    counts: how many queries reach so many buckets.  Gives the first block and the number of blocks for every reach, and for
    every bucket how many blocks it meets; far-reaching blocks come first, so that these are the blocks 0 to that number.
    """
    where: dict[int, tuple[int, int]] = {}
    met = [0] * buckets
    first, held, total = 0, [], 0
    least = min(counts, default=0)
    for reach in sorted(counts, reverse=True):
        held.append(reach)
        total += counts[reach]
        if total >= block or reach == least:
            n = -(-total // block)
            where |= {r: (first, n) for r in held}
            first += n
            met[: held[0]] = [first] * held[0]
            held, total = [], 0
    return where, met


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, bucket_rows: int = 8192, block: int = 2048, most_buckets: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score.  queries: the rows (vec_id, embedding) that ask."""

    def whole(df: DataFrame) -> DataFrame:
        x = F.col("embedding").cast("array<double>")
        fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
        return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
        )

    cands = whole(vectors).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    asks = whole(queries).withColumnRenamed("vec_id", "query_id")

    # bucket edges from a histogram of lengths: powers of two, finely cut, so at most a few thousand counts, and salts
    # keep buckets of one length bounded
    grain = 64.0
    cands = cands.withColumn("g", F.floor(F.log2(F.col("norm2") + 1) * grain).cast("int"))
    counts = sorted(((r["g"], r["n"]) for r in cands.groupBy("g").agg(F.count("*").alias("n")).collect()), reverse=True)
    total = sum(n for _, n in counts)
    if not total:
        return cands.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    size = max(bucket_rows, total // most_buckets + 1)
    bucket_of, held, bucket = {}, 0, 0
    for g, n in counts:  # numbered without gaps, however many vectors have one length
        if held >= size:
            bucket, held = bucket + 1, 0
        bucket_of[g] = bucket
        held += n
    bounds: dict[int, float] = {}
    for g, _ in counts:
        bounds.setdefault(bucket_of[g], 2.0 ** ((g + 1) / grain))  # no squared length of the bucket is above this
    rows: dict[int, int] = {}
    for g, n in counts:
        rows[bucket_of[g]] = rows.get(bucket_of[g], 0) + n
    pick = F.create_map(*[F.lit(x) for g, b in bucket_of.items() for x in (g, b)])
    parts = F.create_map(*[F.lit(x) for b, n in rows.items() for x in (b, n // bucket_rows + 1)])
    cands = cands.withColumn("bucket", pick[F.col("g")]).withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("bucket")]).cast("int"))

    n_blocks = asks.count() // block + 1
    asks = asks.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_blocks)).cast("int"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """left: query_id, v, floor, bucket, part, block; right: vec_id, v, bucket, part, block."""

        def run(q, c):
            import pandas as pd

            if not len(q) or not len(c):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            out: list[tuple[int, int, int]] = []
            q_dim, c_dim = q["v"].map(len).to_numpy(), c["v"].map(len).to_numpy()
            for d in np.unique(q_dim).tolist():
                qs, cs = q[q_dim == d], c[c_dim == d]
                if len(cs):
                    floors = np.array([None if x == NO_FLOOR else x for x in qs["floor"].tolist()], object)
                    out += bucket_top(qs["query_id"].to_numpy(), _matrix(qs["v"].tolist()).reshape(len(qs), d), floors, cs["vec_id"].to_numpy(), _matrix(cs["v"].tolist()).reshape(len(cs), d), k)
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

        keys = ["bucket", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, SCHEMA)

    spread = lambda c, met: c.select("vec_id", "v", "bucket", "part", F.explode(F.sequence(F.lit(0), met - 1)).alias("block"))
    by_part = lambda q: q.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("bucket")] - 1)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    ranked = lambda s: s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    first = asks.withColumn("bucket", F.lit(0)).withColumn("floor", F.lit(NO_FLOOR))
    seen = meet(by_part(first), spread(cands.where("bucket = 0"), F.lit(n_blocks)))
    seen = stored(seen.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
    if len(bounds) > 1:
        floors = seen.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        need = asks.join(floors, "query_id", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("low")).otherwise(NO_FLOOR))
        low = F.col("floor").cast("double")
        norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        highest = F.array(*[F.lit(bounds[b]) for b in sorted(bounds)])
        # |query|**2 * |bucket|**2 below floor**2: this bucket and all later ones cannot matter
        alive = F.size(F.filter(highest, lambda h: (low <= 0) | (h * norm2 * (1 + 1e-9) >= low * low)))
        later = stored(need.select("query_id", "v", "floor", alive.alias("alive")).where("alive > 1"))
        where, met = deal({r["alive"]: r["n"] for r in later.groupBy("alive").agg(F.count("*").alias("n")).collect()}, block, len(bounds))  # a count a bucket at most
        if not where:
            return ranked(seen)
        begun, dealt = (F.create_map(*[F.lit(x) for reach, at in where.items() for x in (reach, at[i])])[F.col("alive")] for i in (0, 1))
        later = later.withColumn("block", (begun + F.pmod(F.xxhash64("query_id", F.lit(1)), dealt)).cast("int"))
        later = later.withColumn("bucket", F.explode(F.sequence(F.lit(1), F.col("alive") - 1)))
        copies = F.array(*[F.lit(n) for n in met])
        # candidates go to the blocks that reach their bucket, and to no other
        rest = meet(by_part(later.select("query_id", "v", "floor", "block", "bucket")), spread(cands.where("bucket > 0").withColumn("met", F.get(copies, F.col("bucket"))).where("met > 0"), F.col("met")))
        seen = seen.unionByName(rest)
    return ranked(seen)


def every_nth(vectors: DataFrame, n: int = 20) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by n."""
    return vectors.where(F.col("vec_id") % n == 0).select("vec_id", "embedding")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
