"""N-gram Jaccard join: documents linked by the overlap of their word shingles, and the components of the links.

All sets agree on one order of shingles, the frequent ones last; how frequent a shingle is, a table of counts over all
documents tells, of fixed size, where some shingles share a cell.  Two sets that reach the threshold share at least T
shingles among the first n - ceil(t n) + T of each, T being a twentieth of the smaller set.  One shuffle on the shingle gives
these lists; entries without another set of fitting size in their list go at once, and so do sets in fewer than T lists.
Equal sets are one vertex from the start.

Only the components matter.  First every set is compared with one partner, the first of its lists that it meets most often,
which joins up large groups.  A list's first member, its hub, is the one at the centre: it has most shingles that are about as frequent
as the list's, and fewest others.

Lists are then cut by size, each set being in its own size's part and the next, and only parts that still hold several components
stay, with the sets that are in T such lists or more.  Parts of FEW sets are merged and counted: a pair that shares no larger part
meets T times in them.  So what meets by chance, and grows faster than the corpus, costs rows of numbers and no sets.
Larger parts are searched through differences: each member is told by its difference from the hub.  Two members linked to their hub are in one component already.  Any other two have as much apart as their differences have, so a link takes a known overlap of
the differences, and these differ even in a group of thousands of near copies, whose sets do not.  A part that holds one component
beside its hub asks for links to the hub alone, and a hub's members, while they are FEW, are compared with one another.

For more members, T-occurrence search over the inverted lists of differences (hub, shingle): as above, two differences that make a link share at
least T shingles among the first ones of each.  DivideSkip: up to T - 1 of a difference's longest lists (over LONG entries) are
left out when lists are merged and counted; partners met often enough in the merged ones are then decided by binary probes of
one difference in the other.  Nothing is capped: a pair of different components that meets often enough is always compared.

Sets are compared as 64-bit hashes of their shingles.  Texts without words have empty sets and link with nothing.  Rows of equal
text, also of one doc_id, are one vertex, and so are rows without doc_id, which link and bridge like any others; a component is
named by its smallest doc_id (null if all are).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, shuffles_end, stored, texts

BASE, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
LONG = 32  # entries of a list that DivideSkip may leave out
FEW = 32  # members of a hub that are compared without lists of their differences; sets in a part of a list whose pairs are counted
SHARE = 20  # T is that part of a set
CELL_BITS = 23  # of the table of counts: that many cells, by the highest bits of a shingle's hash
CHUNK = 1 << 17  # cells of the table in a row
HOT_LIST = 1_000_000  # a shingle that may be in more texts is not gathered in one task
SEEN_MOST = 50_000  # vertices a task remembers, to write copies once
BITS = 1 << 24  # of the filter that tells which texts are read again
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the hash base and of its inverse, as long as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 17)
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; below `size` words, of its one whole sequence."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_BREAK[raw], out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        k = min(size, len(words))
        n = len(words) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
            h ^= h >> np.uint64(32)
        return np.unique(_mix(h))


def _least_shared(n: int, percent: int) -> int:
    """Fewest shingles shared by a set of n with any partner that reaches the threshold."""
    return -(-percent * n // 100)


def _occurrences(n: int) -> int:
    """T: how many shingles of their prefixes two sets share, the smaller one having n."""
    return max(1, n // SHARE)


def _needed(n: Column) -> Column:
    """_occurrences() of a column."""
    return F.greatest(F.floor(n / SHARE), F.lit(1))


def _needed_of(n: Column, percent: int) -> Column:
    """T for a set of n and its smallest partner."""
    return _needed(F.ceil(n * percent / 100))


def _most_apart(n: int, percent: int) -> int:
    """The largest symmetric difference of linked sets that have n shingles together."""
    return n * (100 - percent) // (100 + percent)


def _vertex(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _read(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set size, vertex and text_key of every row; and each task's table of counts, in chunks, up to 255 a cell."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["doc_id", "n", "v", "text_key", "chunk", "part", "counts"]
        counts = np.zeros(1 << CELL_BITS, np.uint8)
        for batch in batches:
            rows, column = [], batch.column(1)
            for i, d in enumerate(batch.column(0).to_pylist()):
                h = shingle_set(column[i].as_py(), size)
                rows.append((d, len(h), _vertex(h) if len(h) else None))
                cells, more = np.unique(_cells(h), return_counts=True)
                counts[cells] = np.minimum(counts[cells] + more, 255)
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [batch.column(2)] + none, names)
        part = TaskContext.get().partitionId() // 512
        chunks = counts.reshape(-1, CHUNK)
        for k in np.flatnonzero(chunks.any(1)).tolist():
            none = [pa.nulls(1, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(none + [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([chunks[k].tobytes()], pa.binary())], names)

    keyed = texts(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, n long, v long, text_key long, chunk int, part int, counts binary")


def _levels(read: DataFrame) -> np.ndarray:
    """The table of counts over all documents, each cell as a level: 4 log2(1 + count).  Its size is fixed."""

    def added(dtype, last: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for chunk, part, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    key = (chunk, 0 if last else part)
                    if key not in held:
                        held[key] = np.zeros(CHUNK, np.uint32)
                    held[key] += np.frombuffer(data, dtype)
            for (chunk, part), x in held.items():
                if last:
                    x = np.round(4 * np.log2(1.0 + x)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) if last else x.tobytes()], pa.binary())], ["chunk", "part", "counts"])

        return run

    schema = "chunk int, part int, counts binary"
    tables = read.where("chunk IS NOT NULL").select("chunk", "part", "counts")
    tables = tables.repartition("chunk", "part").mapInArrow(added(np.uint8, False), schema)  # 512 tasks' tables at most
    with shuffles_end(read.sparkSession):
        rows = tables.repartition("chunk").mapInArrow(added(np.uint32, True), schema).collect()
    levels = np.zeros((1 << CELL_BITS) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK)
    for r in rows:
        levels[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return levels.reshape(-1)


def in_order(d: np.ndarray, hub: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hashes of a difference in the common order of all that have this hub.

    First what the hub has not, the rarest first; then what it has alone, the most frequent first, as few lack these.
    """
    level = levels[_cells(d)]
    lacked = hub[np.minimum(np.searchsorted(hub, d), len(hub) - 1)] == d
    return d[np.argsort(np.where(lacked, 255 - level, level), kind="stable")]


def _lists(docs: DataFrame, size: int, percent: int, table) -> DataFrame:
    """(shingle, v, n, score, salt) of every prefix, once for each vertex that a task remembers.  Hot shingles are salted by vertex.

    score: how near the set is to the centre of a group, as seen from this shingle: its shingles of half the frequency or more, less the others.
    """
    hot = int(4 * np.log2(1.0 + HOT_LIST))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        levels = table.value
        seen: set[int] = set()
        names = ["shingle", "v", "n", "score", "salt"]

        def made(held):
            tokens, scores, vs, ns = zip(*held, strict=True)
            times = [len(x) for x in tokens]
            tokens, vs, ns = np.concatenate(tokens), np.repeat(np.array(vs), times), np.repeat(np.array(ns, np.int32), times)
            salt = np.where(levels[_cells(tokens)] >= hot, 1 + (vs & 63), 0).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(tokens), vs, ns, np.concatenate(scores).astype(np.int32), salt)], names)

        for batch in batches:
            held, amount = [], 0
            for i in range(batch.num_rows):
                h = shingle_set(batch.column(1)[i].as_py(), size)
                if not len(h) or (v := _vertex(h)) in seen:
                    continue
                if len(seen) >= SEEN_MOST:
                    seen.clear()
                seen.add(v)
                mine = levels[_cells(h)]
                order = np.argsort(mine, kind="stable")
                mine, head = mine[order], order[: len(h) - _least_shared(len(h), percent) + _occurrences(len(h))]
                rarer = np.searchsorted(mine, np.maximum(mine[: len(head)], 4) - 4)
                held.append((h[head], len(h) - 2 * rarer, v, len(h)))
                amount += len(held[-1][0])
                if amount > 100_000:
                    yield made(held)
                    held, amount = [], 0
            if held:
                yield made(held)

    return texts(docs).mapInArrow(run, "shingle long, v long, n int, score int, salt int")


def _shared(lists: DataFrame, percent: int) -> DataFrame:
    """(shingle, v, n, score) of lists(shingle, v, n, score, salt), each set once, beside which the list has another of fitting size."""
    by_size = Window.partitionBy("shingle", "salt").orderBy("n", "v")
    once = lists.withColumn("before", F.lag("v").over(by_size)).where("before IS NULL OR before <> v")
    once = once.withColumns({"smaller": F.lag("n").over(by_size), "larger": F.lead("n").over(by_size)})
    beside = _fits(F.coalesce("smaller", F.lit(0)), F.col("n"), percent) | _fits(F.col("n"), F.coalesce("larger", F.lit(0)), percent)
    return once.where(beside | (F.col("salt") > 0)).select("shingle", "v", "n", "score")  # hot ones are taken as shared


def _sets(docs: DataFrame, size: int, wanted: DataFrame, tables: Tables) -> DataFrame:
    """(v, h) of the wanted (text_key, v).  A filter of fixed size spares hashing most other texts; the join decides."""
    words = wanted.select(F.pmod("text_key", F.lit(BITS)).alias("spot")).groupBy(F.floor(F.col("spot") / 64).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    table = tables.share(bits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "v", "h"])
        for batch in batches:
            keys = batch.column(1).to_numpy()
            at = keys % BITS
            rows, held = [], 0
            for i in np.flatnonzero((table.value[at // 64] >> (at % 64)) & 1).tolist():
                h = shingle_set(batch.column(0)[i].as_py(), size)
                key = (int(keys[i]), _vertex(h)) if len(h) else None
                if key is None or key in seen:
                    continue
                if len(seen) >= SEEN_MOST:
                    seen.clear()
                seen.add(key)
                rows.append((*key, h.tobytes()))
                held += len(h)
                if held > 200_000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    got = texts(docs).select("text", F.xxhash64("text").alias("key")).mapInArrow(run, "key long, v long, h binary")
    # equal keys by their difference in bits: the join is dealt by v alone, as the last step needs it, and sets move once
    return got.join(wanted, "v").where(F.col("key").bitwiseXOR(F.col("text_key")) == 0).dropDuplicates(["v"]).select("v", "h")


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the symmetric difference, the smaller one probed in the larger by binary search."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return len(a) + len(b) - 2 * int((b[at] == a).sum())


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The links among pairs(a, b, na, nb, ha, hb): sets, or differences from one hub, that are not too far apart."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [i for i in range(batch.num_rows) if _apart(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))) <= _most_apart(na[i] + nb[i], percent)]
            if keep:
                yield batch.select([0, 1]).take(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long")


def _differences(members: DataFrame, sets: DataFrame, percent: int, table) -> DataFrame:
    """members(v, hub, wide, many) -> v, hub, n, m (size of the difference), t, linked, head (the first shingles of the difference), d.

    d is null where not wide, as the link to the hub is all that is asked there; head is null where the hub's members are few.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        levels = table.value
        schema = pa.schema([("v", pa.int64()), ("hub", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("t", pa.int64()), ("linked", pa.bool_()), ("head", pa.list_(pa.int64())), ("d", pa.binary())])
        for batch in batches:
            vs, hubs, wide, many = (batch.column(c).to_pylist() for c in (0, 1, 4, 5))
            rows, held = [], 0
            for i in range(batch.num_rows):
                mine, other = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                linked = _apart(mine, other) <= _most_apart(len(mine) + len(other), percent)
                if not wide[i]:
                    if linked:
                        rows.append((vs[i], hubs[i], len(mine), None, None, True, None, None))
                    continue
                d = np.setxor1d(mine, other, assume_unique=True)
                most = len(mine) * (100 - percent) // percent  # apart from any partner
                # no more than a quarter of what any link shares, nor so many that heads reach what all members lack
                t = max(1, min((len(d) - most) // 4, _occurrences(len(mine))))
                rows.append((vs[i], hubs[i], len(mine), len(d), t, linked, _signed(in_order(d, other, levels)[: most + t]) if many[i] else None, d.tobytes()))
                held += len(d)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # both joins read the same shuffle of sets by v; of hubs alone the sets move on
    hubs = sets.join(members.select(F.col("hub").alias("v")).distinct(), "v").select(F.col("v").alias("hub"), F.col("h").alias("hh"))
    both = members.join(sets, "v").join(hubs, "hub").select("v", "hub", "h", "hh", "wide", "many")
    return both.mapInArrow(run, "v long, hub long, n long, m long, t long, linked boolean, head array<long>, d binary")


def _linked_among(groups: DataFrame, percent: int) -> DataFrame:
    """The links between different components in each row of groups(held): at most FEW of (v, c, n, m, linked, d), d from one hub."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: list[tuple[int, int]] = []
            for held in batch.column(0):
                rows = [(*(x[k].as_py() for k in ("v", "c", "n", "m", "linked")), np.frombuffer(x["d"].as_buffer(), np.uint64)) for x in held]
                for (v, c, n, m, to_hub, d), (w, c2, n2, m2, to_hub2, d2) in itertools.combinations(rows, 2):
                    most = _most_apart(n + n2, percent)
                    if c != c2 and not (to_hub and to_hub2) and abs(m - m2) <= most and _apart(d, d2) <= most:
                        found.append((v, w))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(v, c): every vertex of links(a, b) with the smallest vertex of its component, by alternating stars.  The last of the tables, name and its number, stays."""
    edges = tables.keep(f"{name}0", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).where("u <> w").distinct())
    before = None
    for step in itertools.count(1):
        sides = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = sides.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = sides.join(low, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w")).unionByName(low.select("u", F.col("m").alias("w")))
        edges = tables.keep(f"{name}{step}", small.where("u <> w").distinct())
        tables.drop(f"{name}{step - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("w").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if now == before and now[0] == now[3]:
            return edges.select(F.col("u").alias("v"), F.col("w").alias("c")).unionByName(edges.select(F.col("w").alias("v"), F.col("w").alias("c")).distinct())
        before = now


def _open_parts(placed: DataFrame, percent: int) -> DataFrame:
    """placed(shingle, v, n, score, c) by parts of lists, as (shingle, part, own, v, n, score, c), where a part holds several components.

    Sets of fitting sizes are in one part: each is in that of its own size and in the next.
    """
    step = math.log(100 / percent) * 1.000001  # rounding never puts fitting sizes two parts apart
    rows = placed.withColumn("own", F.floor(F.log("n") / step).cast("int")).withColumn("part", F.explode(F.array("own", F.col("own") + 1)))
    several = rows.groupBy("shingle", "part").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("shingle", "part")
    return rows.join(several, ["shingle", "part"])


def _met(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of different components that meet in T lists or more, counted in the part of the larger one's size alone."""
    p, q = (placed.select("shingle", "part", "own", "v", "n", "c").alias(x) for x in "pq")
    rows = p.join(q, (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.part") == F.col("q.part")) & (F.col("p.v") < F.col("q.v")))
    rows = rows.where((F.col("p.c") != F.col("q.c")) & (F.col("p.part") == F.greatest("p.own", "q.own")) & _fits(F.col("p.n"), F.col("q.n"), percent))
    rows = rows.groupBy(F.col("p.v").alias("a"), F.col("q.v").alias("b")).agg(F.count("*").alias("times"), F.max("p.n").alias("na"), F.max("q.n").alias("nb"))
    return rows.where(F.col("times") >= _needed(F.least("na", "nb"))).select("a", "b", "na", "nb")


def _through_hubs(shared: DataFrame, known: DataFrame, sets: DataFrame, percent: int, table, tables: Tables) -> DataFrame:
    """Links (a, b) between different components of known(v, c) among the members of the lists shared(shingle, v, n, score).

    Drops the tables shared and sets; the links read its own, near, pairs and diffs.
    """
    placed = shared.join(known, "v", "left").withColumn("c", F.coalesce("c", "v"))
    parts = tables.keep("parts", _open_parts(placed, percent))
    tables.drop("shared")
    able = parts.groupBy("v").agg(F.count_distinct("shingle").alias("lists"), F.max("n").alias("n")).where(F.col("lists") >= _needed_of(F.col("n"), percent))
    placed = parts.join(able.select("v"), "v")
    held = placed.groupBy("shingle", "part").agg(F.count("*").alias("held"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y")
    placed = tables.keep("placed", placed.join(held.select("shingle", "part", "held"), ["shingle", "part"]))
    tables.drop("parts")
    met = tables.keep("met", _met(placed.where(F.col("held") <= FEW), percent))
    side = lambda x: sets.join(met.select(F.col(x).alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias(x), F.col("h").alias("h" + x))
    near = tables.keep("near", _linked(met.join(side("a"), "a").join(side("b"), "b"), percent))
    tables.drop("met")

    placed = placed.where(F.col("held") > FEW)
    lists = placed.groupBy("shingle", "part", "c").agg(F.max(F.struct("score", "v", "n")).alias("top"), F.count("*").alias("held"))
    lists = lists.groupBy("shingle", "part").agg(F.count("*").alias("parts"), F.max(F.struct("top", "held")).alias("k")).where("parts > 1")
    # beside the hub there are several components, or else only links to the hub are left to find
    wide = F.col("parts") - (F.col("k.held") == 1).cast("int") > 1
    lists = lists.select("shingle", "part", F.col("k.top.v").alias("hub"), F.col("k.top.n").alias("hub_n"), wide.alias("wide"))
    members = placed.join(lists, ["shingle", "part"]).where((F.col("v") != F.col("hub")) & (F.col("wide") | _fits(F.col("n"), F.col("hub_n"), percent)))
    members = tables.keep("members", members.groupBy("v", "hub").agg(F.max("wide").alias("wide")))
    crowded = members.where("wide").groupBy("hub").count().where(F.col("count") > FEW).select("hub", F.lit(True).alias("many"))
    members = members.join(crowded, "hub", "left").select("v", "hub", "wide", F.coalesce(F.col("wide") & F.col("many"), F.lit(False)).alias("many"))
    tables.drop("placed")
    diffs = tables.keep("diffs", _differences(members, sets, percent, table))
    tables.drop("sets", "members")
    to_hub = diffs.where("linked").select(F.col("v").alias("a"), F.col("hub").alias("b"))

    # a hub's few members meet each other in one row
    few = diffs.where("head IS NULL AND d IS NOT NULL").join(known, "v", "left").withColumn("c", F.coalesce("c", "v"))
    few = few.groupBy("hub").agg(F.collect_list(F.struct("v", "c", "n", "m", "linked", "d")).alias("held"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y")
    among = _linked_among(few.select("held"), percent)

    # inverted lists of the heads of many members' differences
    heads = diffs.where("head IS NOT NULL").join(known, "v", "left").select("v", "hub", "n", "m", "t", "linked", F.coalesce("c", "v").alias("c"), F.posexplode("head").alias("at", "shingle"))
    sizes = heads.groupBy("hub", "shingle").agg(F.count("*").alias("df")).where("df > 1")
    lists = tables.keep("heads", heads.join(sizes, ["hub", "shingle"]))
    long_first = Window.partitionBy("hub", "v").orderBy(F.desc("df"), "shingle")
    probes = lists.withColumn("skipped", (F.col("df") > LONG) & (F.row_number().over(long_first) < F.col("t")))
    probes = probes.withColumn("need", F.col("t") - F.count_if("skipped").over(Window.partitionBy("hub", "v"))).where("NOT skipped")
    p, q = probes.alias("p"), lists.alias("q")
    n, m = F.col("p.n") + F.col("q.n"), F.col("p.m") + F.col("q.m")
    # what both differences hold, at least, if this is a link
    overlap = F.ceil((m - F.floor(n * (100 - percent) / (100 + percent))) / 2)
    reached = lambda x: F.col(f"{x}.at") < F.col(f"{x}.m") - overlap + F.col("p.t")
    order = (F.col("p.t") < F.col("q.t")) | ((F.col("p.t") == F.col("q.t")) & (F.col("p.v") < F.col("q.v")))
    apart = (F.col("p.c") != F.col("q.c")) & ~(F.col("p.linked") & F.col("q.linked"))
    met = p.join(q, (F.col("p.hub") == F.col("q.hub")) & (F.col("p.shingle") == F.col("q.shingle"))).where(apart & order & _fits(F.col("p.n"), F.col("q.n"), percent) & reached("p") & reached("q"))
    pairs = met.groupBy(F.col("p.hub").alias("hub"), F.col("p.v").alias("a"), F.col("q.v").alias("b")).agg(F.count("*").alias("times"), F.max("p.need").alias("need")).where("times >= need")
    pairs = tables.keep("pairs", pairs.select("hub", "a", "b"))
    tables.drop("heads")
    # pairs are few beside members, so only differences that some pair needs are dealt
    asked = pairs.select("hub", F.col("a").alias("v")).unionByName(pairs.select("hub", F.col("b").alias("v")))
    needed = diffs.select("v", "hub", "n", "d").join(asked, ["hub", "v"], "left_semi")
    side = lambda x: needed.select(F.col("v").alias(x), "hub", F.col("n").alias("n" + x), F.col("d").alias("h" + x))
    return near.unionByName(to_hub).unionByName(among).unionByName(_linked(pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"]), percent))


def similarity_components(docs: DataFrame, size: int = 5, percent: int = 80, tables: Tables | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id; text_key (xxhash64 of the text), which tells rows of one doc_id apart; and group_id, one number a component, null for empty sets."""
    spark = docs.sparkSession
    tables = tables or Tables(spark)
    read = tables.keep("read", _read(docs, size))
    table = tables.share(_levels(read))
    # the tasks' tables of counts are most of it, and no later step reads them
    rows = tables.keep("rows", read.where(F.col("chunk").isNull()).select("doc_id", "n", "v", "text_key"))
    tables.drop("read")
    named = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("name"), F.min("text_key").alias("text_key"))

    shared = tables.keep("lists", _shared(_lists(docs, size, percent, table), percent))
    # a set that shares fewer than T of its shingles with any other has no link
    able = shared.groupBy("v").agg(F.count("*").alias("lists"), F.max("n").alias("n")).where(F.col("lists") >= _needed_of(F.col("n"), percent)).select("v")
    shared = tables.keep("shared", shared.join(able, "v"))
    tables.drop("lists")
    wanted = tables.keep("wanted", named.join(shared.select("v").distinct(), "v").select("text_key", "v"))
    sets = tables.keep("sets", _sets(docs, size, wanted, tables))
    tables.drop("wanted")

    # one partner each: of its lists' first members the one met most often
    first = shared.groupBy("shingle").agg(F.max(F.struct("score", "v", "n")).alias("hub"))
    met = shared.join(first, "shingle").where(_fits(F.col("n"), F.col("hub.n"), percent) & (F.col("v") != F.col("hub.v")))
    met = met.groupBy("v", F.col("hub.v").alias("hub")).agg(F.count("*").alias("times"), F.max("n").alias("n"), F.max("hub.n").alias("hub_n"))
    partner = tables.keep("partner", met.groupBy("v").agg(F.max(F.struct("times", "hub", "n", "hub_n")).alias("k")).select(F.col("v").alias("a"), F.col("k.hub").alias("b"), F.col("k.n").alias("na"), F.col("k.hub_n").alias("nb")))
    side = lambda x: sets.select(F.col("v").alias(x), F.col("h").alias("h" + x))
    known = tables.keep("known", components(_linked(partner.join(side("a"), "a").join(side("b"), "b"), percent), tables, "star"))
    tables.drop("partner")

    # all other links, as links between components
    more = _through_hubs(shared, known, sets, percent, table, tables)
    for x in ("a", "b"):
        more = more.join(known.select(F.col("v").alias(x), F.col("c").alias("c" + x)), x, "left")
    joined = components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), tables, "whole").select("v", F.col("c").alias("whole"))
    tables.drop("near", "pairs", "diffs")

    named = named.join(known, "v", "left").select("v", "name", F.coalesce("c", "v").alias("c"))
    named = named.join(joined.withColumnRenamed("v", "c"), "c", "left").select("v", "name", F.coalesce("whole", "c").alias("c"))
    least = named.groupBy("c").agg(F.min("name").alias("component_id"))
    found = named.join(least, "c").select("v", "component_id", F.col("c").alias("group_id"))
    full = rows.where("v IS NOT NULL").join(found, "v").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key", "group_id")
    none = F.lit(None).cast("long").alias("group_id")
    return full.unionByName(rows.where("v IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", none))


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Sizes that leave room for the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; rows without doc_id come last.

    Documents without shingles are in no group and stay.  Equal rows (same doc_id and text) count once, but those of empty
    sets without doc_id all stay.
    """
    tables = Tables(docs.sparkSession)
    found = similarity_components(docs, size, percent, tables)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    keys = found.select("doc_id", "text_key", "group_id").groupBy("group_id", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    first = keys.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min(F.struct(row.alias("row"), "copies")).alias("k")).select("k.row.doc_id", "k.row.text_key", "k.copies")
    alone = keys.where("group_id IS NULL").select("doc_id", "text_key", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("copies")).alias("copies"))
    kept = stored(first.unionByName(alone)).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), "copies")
    tables.drop_all()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    repeated = rows.where("copies > 1").dropDuplicates(["id", "key"])  # few, so few texts are shuffled twice
    return rows.where("copies = 1").unionByName(repeated).select("row.*")
