"""Near-duplicate components by an exact set-similarity self-join on word shingles.

A text is the set of its five-word shingles; two texts link when the Jaccard similarity of their sets is 0.8 or
more. The join is exact and works on set relations:

1. Equal sets are one node from then on, so copies cost one row each.
2. Every shingle gets its exact document frequency in one exchange by shingle. A shingle of one set alone can't be shared,
   so a set's answers follow from its shared shingles only, and a set that shares under 80 % of them has none.
3. Shared shingles stand in one global order, rare ones first. Two linked sets have a common one among the first
   ``n - ceil(0.8 n) + 1`` shingles of each, so only those are indexed, and the unshared ones among them index nothing.
4. Near copies first: of the sets that agree in a smallest hash the most central one, whose shingles are the most
   widely shared, leads, and the others are compared with it alone. Work is linear in the sets of a group.
5. The index then answers for sets of different groups. A list of one group is skipped; the others are passed in blocks
   that know their least and greatest size and least position, and pairs of blocks that can't reach the overlap are
   skipped whole. Lists over BLOCK sets are dealt over tasks by pairs of parts.
6. A set's answers derive from its leader's: leaders are compared once for all pairs of their members; where these link
   nothing is left to do, and where the leaders lie farther apart than both members' changes can bridge, the
   members' pair is excluded. Only what is left is compared.
7. Links become components by alternating star contraction.

Skew: shingles of the fullest of a fixed number of counters (at most COUNTERS / HEAVY of them) are not exchanged by
shingle, but rank last in the global order, so no task gets the sets of a very frequent passage.

Defined results: a null or empty text has 0 shingles and its own id as component; a text of under five words has one
shingle, its whole sequence; rows that repeat an id are one document, linked with each other; a row of null id gets a
null component; an empty table gives an empty table. Texts are used whole, whatever their length. Only the two named
columns are read, so other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import batches, checkpointed

WORDS = 5
#: Least similarity, in percent.
PERCENT = 80
#: Counters of hashed shingles; one of them is heavy from HEAVY times their mean and from HEAVY_LEAST on.
COUNTERS, HEAVY, HEAVY_LEAST = 1 << 20, 4, 64
#: Shingles that a task puts in order together, and that an exchange's group holds on average.
FLUSH, GROUP = 2_000_000, 2_000_000
#: Turns of comparisons with leaders, by another hash each; the index finds all links left.
TURNS = 3
#: Sets of an index list that are compared in one task, and of one block of it.
BLOCK, SKIP = 4096, 64
#: Pairs (16 bytes each) that are broadcast to the sets, by count; beyond, they are joined by a shuffle.
BROADCAST_PAIRS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HASH = np.uint64((1 << 56) - 1)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP, _BACK = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def combined(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of 56 bits of each run of ``size`` words."""
    h = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        h = h * _BASE + words[k : len(words) - size + 1 + k]
    return mixed(h) >> np.uint64(8)


def raw_shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's shingles, repeats included.

    All texts' words are hashed together: a word is the difference of two running sums of bytes times powers of an odd
    number, taken back to the first power.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    space = _SPACE[data]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_STEP, len(data)), out=sums[1:])
    words = mixed((sums[last] - sums[first]) * powers(_BACK, len(data))[first])
    ends = np.cumsum([len(p) + 1 for p in parts])
    bounds = np.concatenate([[0], np.searchsorted(first, ends, side="right")])
    runs = combined(words, WORDS)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(runs[a : b - WORDS + 1] if b - a >= WORDS else combined(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def all_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    for a, b in batches(texts):
        yield from map(np.unique, raw_shingles(texts[a:b]))


def name_of(h: np.ndarray) -> int:
    """The set's own name of 64 bits; sets of equal names are equal."""
    return int(mixed(np.add.reduce(h * h, keepdims=True, dtype=np.uint64) * _BASE + np.add.reduce(mixed(h), dtype=np.uint64) + np.uint64(len(h)))[0].view(np.int64))


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(56 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_length(n):
    """Shingles of a set of ``n`` that are indexed."""
    return n - -(-PERCENT * n // 100) + 1


def named(source: DataFrame) -> DataFrame:
    """(id, n, s) of each text, and (n, slot) of the counters that are full in a task, all else null.

    A counter that is heavy over all tasks holds as much above the mean in one of them at least.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in rows:
            n, s = [], []
            for h in all_sets(batch.column(1).to_pylist()):
                np.add.at(counts, counter_of(h), 1)
                n.append(len(h))
                s.append(name_of(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.nulls(len(n), pa.int64())], names=["id", "n", "s", "slot"])
        full = np.flatnonzero(counts >= 8 + HEAVY / 2 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), pa.array(counts[full]), pa.nulls(len(full), pa.int64()), pa.array(full)], names=["id", "n", "s", "slot"])

    return source.mapInArrow(run, "id bigint, n bigint, s bigint, slot bigint")


def frequency_class(df: np.ndarray, heavy: bool = False) -> np.ndarray:
    """Place of a frequency in the global order, in 7 bits: by its logarithm, heavy ones last."""
    level = np.log2(np.maximum(df, 1))
    return (96 + np.minimum(31, level) if heavy else np.minimum(95, 6 * level)).astype(np.uint64)


def heavy_counters(rows: DataFrame, total: int) -> np.ndarray:
    """Class of each counter, 0 if it isn't heavy. At most COUNTERS / HEAVY of them come to the driver."""
    counted = rows.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HEAVY_LEAST, HEAVY * total / COUNTERS))
    table = np.zeros(COUNTERS, np.uint8)
    for r in counted.collect():
        table[r["slot"]] = frequency_class(np.array([r["n"]]), heavy=True)[0]
    return table


#: Rows of an exchange: for each set of a group its name, the number of its entries and, if ``known``, its size; the entries.
PACKED = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("s", pa.binary()), ("count", pa.binary()), ("n", pa.binary()), ("entries", pa.binary())])
PACKED_SQL = "part int, known boolean, s binary, count binary, n binary, entries binary"


def packed(part: np.ndarray, s: np.ndarray, entry: np.ndarray, width: int, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows by part of entries of ``width`` bytes; ``n``, if given, has a size for each entry, and an entry of 0 is none."""
    order = np.lexsort((entry, s, part))
    part, s, entry = part[order], s[order], entry[order]
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    rows = []
    for a, b in zip(edge, np.r_[edge[1:], len(part)] if len(part) else [], strict=True):
        first = a + np.flatnonzero(np.r_[True, s[a + 1 : b] != s[a : b - 1]])
        size = np.zeros(0, np.uint32) if n is None else n[order[first]].astype(np.uint32)
        own = entry[a:b]
        counts = np.add.reduceat((own != 0).astype(np.uint32), first - a)
        own = own[own != 0]
        data = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
        rows.append((int(part[a]), n is not None, s[first].tobytes(), counts.astype(np.uint32).tobytes(), size.tobytes(), data))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED)], schema=PACKED)


def unpacked(table: pa.Table, width: int, known: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sets' names, their sizes, their counts; names by entry, entries) of a group's rows."""
    table = table.filter(table["known"] if known else pc.invert(table["known"]))
    whole = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    s, counts = whole("s", np.int64), whole("count", np.uint32)
    raw = whole("entries", np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return s, whole("n", np.uint32), counts, np.repeat(s, counts), wide.reshape(-1).view(np.uint64)


def parted(s: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(s.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def shared_sets(source: DataFrame, heavy: np.ndarray, parts: int) -> DataFrame:
    """(s, n, shared, central, firsts) of the sets that may have a partner, once for each set.

    ``shared`` has the shingles that other sets have too, as longs in the global order; ``central`` says how widely they
    are shared; ``firsts`` has a smallest hash for each turn. Two exchanges: by shingle, which counts the sets of each, and
    back by set. Both deal groups of bounded size by hash.
    """
    classes = source.sparkSession.sparkContext.broadcast(heavy)

    def flushed(sets: dict[int, np.ndarray], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        s = np.repeat(np.fromiter(sets, np.int64, len(sets)), sizes)
        h = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
        own = classes.value[counter_of(h)].astype(np.uint64)
        yield from packed((h[own == 0] % np.uint64(parts)).astype(np.int32), s[own == 0], h[own == 0], 7)
        # sizes and heavy shingles need no count; they pass to their set's group by a part that only depends on the set
        every = np.fromiter(sets, np.int64, len(sets))
        s, h = np.r_[every, s[own > 0]], np.r_[np.zeros(len(every), np.uint64), (own[own > 0] << np.uint64(56)) | h[own > 0]]
        order = np.argsort(s, kind="stable")
        n = np.repeat(np.array(sizes)[np.argsort(every, kind="stable")], np.unique(s, return_counts=True)[1])
        yield from packed(parted(s[order], parts), s[order], h[order], 8, n)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in rows:
            for h in all_sets(batch.column(0).to_pylist()):
                if len(h):
                    held += len(h)
                    sets[name_of(h)] = h
                    if held > FLUSH:
                        yield from flushed(sets, [*map(len, sets.values())])
                        sets, held = {}, 0
        if sets:
            yield from flushed(sets, [*map(len, sets.values())])

    def count(table: pa.Table) -> pa.Table:
        _, _, _, s, h = unpacked(table, 7, False)
        order = np.argsort(h, kind="stable")
        h, s = h[order], s[order]
        several = np.r_[h[1:] == h[:-1], False] | np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
        h, s = h[several], s[several]
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])] if len(h) else np.zeros(0, bool)
        h, s = h[new], s[new]
        _, which, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[which]
        keep = df > 1
        key = (frequency_class(df[keep]) << np.uint64(56)) | h[keep]
        out = list(packed(parted(s[keep], parts), s[keep], key, 8))
        s, n, counts, _, key = unpacked(table, 8, True)
        every, first = np.unique(s, return_index=True)
        s, key = np.r_[every, np.repeat(s, counts)], np.r_[np.zeros(len(every), np.uint64), key]
        order = np.lexsort((key, s))
        s, key = s[order], key[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (key[1:] != key[:-1])] if len(s) else np.zeros(0, bool)
        s, key = s[new], key[new]
        out += list(packed(parted(s, parts), s, key, 8, np.repeat(n[first], np.unique(s, return_counts=True)[1])))
        return pa.Table.from_batches(out, PACKED)

    names = pa.schema([("s", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int64())), ("central", pa.float64()), ("firsts", pa.list_(pa.int64()))])

    def gather(table: pa.Table) -> pa.Table:
        every, n, _, s, key = unpacked(table, 8, True)
        _, _, _, s2, key2 = unpacked(table, 8, False)
        s, key = np.r_[s, s2], np.r_[key, key2]
        order = np.lexsort((key, s))
        s, key = s[order], key[order]
        every, first = np.unique(every, return_index=True)
        n = n[first].astype(np.int64)
        low, high = np.searchsorted(s, every), np.searchsorted(s, every, side="right")
        may = np.flatnonzero((high - low >= -(-PERCENT * n // 100)) & (high > low))
        lists = [key[low[i] : high[i]] for i in may]
        central = [float(np.sum(x >> np.uint64(56))) / int(n[i]) for i, x in zip(may, lists, strict=True)]
        firsts = [[int(mixed((x & _HASH) * _BASE + np.uint64(t)).min().view(np.int64)) for t in range(TURNS)] for x in lists]
        return pa.table([pa.array(every[may]), pa.array(n[may]), lists_of([x.view(np.int64) for x in lists]), pa.array(central, pa.float64()), pa.array(firsts, pa.list_(pa.int64()))], schema=names)

    rows = source.where("id IS NOT NULL").select("text").mapInArrow(emit, PACKED_SQL)
    counted = rows.groupBy("part").applyInArrow(count, PACKED_SQL)
    return counted.groupBy("part").applyInArrow(gather, "s bigint, n bigint, shared array<bigint>, central double, firsts array<bigint>")


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, apart, linked) of the pairs (a, b): how many shingles one of the two alone has, and whether they link."""
    few = pairs.count() <= BROADCAST_PAIRS
    of = lambda df: F.broadcast(df) if few else df
    a = sets.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x")).join(of(pairs.select("a", "b")), "a")
    b = sets.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y")).join(of(pairs.select("b").distinct()), "b", "left_semi")
    both = a.join(b, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("common"))
    apart = F.col("n_a") + F.col("n_b") - 2 * F.col("common")
    return both.select("a", "b", apart.alias("apart"), (100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("linked"))


def leader_pairs(sets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Each set (a) with the most central one (b) of those that agree in the turn's smallest hash and follow another leader."""
    at = sets.select("s", "n", "central", F.get("firsts", F.lit(turn)).alias("first")).join(labels.select("s", "leader"), "s")
    leaders = at.groupBy("first").agg(F.max_by(F.struct("s", "n", "leader"), F.struct("central", "s")).alias("of"), F.min("leader").alias("low"), F.max("leader").alias("high")).where("low <> high").select("first", "of")
    met = at.join(leaders, "first").where((F.col("leader") != F.col("of.leader")) & (100 * F.least("n", "of.n") >= PERCENT * F.greatest("n", "of.n")))
    return met.select(F.col("s").alias("a"), F.col("of.s").alias("b"))


def list_pairs(n: np.ndarray, at: np.ndarray, group: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a list sorted by set size that may be similar, by size and position, and have different groups.

    The list is passed in blocks of SKIP: a pair of blocks is skipped whole where the greatest size of the first is too
    small for the least of the second, where the shingles left after the blocks' least positions can't reach the
    overlap of their least sizes, or where both have one group only, the same. With ``side``, pairs of one side don't count.
    """
    edge = np.arange(0, len(n), SKIP)
    most = np.maximum.reduceat(n, edge) if len(n) else n
    left_over = np.maximum.reduceat(n - at, edge) if len(n) else n
    low, high = (f.reduceat(group, edge) if len(n) else group for f in (np.minimum, np.maximum))
    left, right = [], []
    for p, a in enumerate(edge.tolist()):
        x = slice(a, a + SKIP)
        least = n[edge[p:]]
        open_ = (100 * most[p] >= PERCENT * least) & (180 * np.minimum(left_over[p], left_over[p:]) >= PERCENT * (n[a] + least))
        open_ &= ~((low[p] == high[p]) & (low[p:] == low[p]) & (high[p:] == low[p]))
        for q in (p + np.flatnonzero(open_)).tolist():
            y = slice(edge[q], edge[q] + SKIP)
            may = (group[x, None] != group[None, y]) & (100 * n[x, None] >= PERCENT * n[None, y]) & (180 * np.minimum((n - at)[x, None], (n - at)[None, y]) >= PERCENT * (n[x, None] + n[None, y]))
            if side is not None:
                may &= side[x, None] != side[None, y]
            i, j = np.nonzero(np.triu(may, 1) if p == q else may)
            left.append(i + a)
            right.append(j + edge[q])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def index_pairs(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different groups that have a common indexed shingle and may be similar."""
    own = sets.join(groups.withColumnRenamed("id", "s"), "s", "left").select("s", "n", F.coalesce("group", "s").alias("group"), "shared")
    lone = F.col("n") - F.size("shared")
    indexed = F.greatest(F.lit(0), (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - lone)).cast("int")
    rows = own.select("s", "n", "group", lone.alias("lone"), F.posexplode(F.slice("shared", F.lit(1), indexed)).alias("at", "shingle"))
    rows = rows.select("shingle", "s", "n", (F.col("at") + F.col("lone")).alias("at"), "group")
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.join(lists.select("shingle", parts.alias("parts")), "shingle").withColumn("own", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    # a list of several parts is passed once for each pair of parts; nearly all lists have one
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("shingle", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "n", "at", "s", "group", "own")
    rows = rows.repartition("shingle", "p", "q").sortWithinPartitions("shingle", "p", "q", "n", "at", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            shingle, p, q, n, at, s, group, own = c
            first = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            a, b = [], []
            for x, y in zip(first.tolist(), [*first[1:].tolist(), len(shingle)], strict=True):
                i, j = list_pairs(n[x:y], at[x:y].astype(np.int64), group[x:y], own[x:y] if p[x] != q[x] else None)
                a.append(s[x:y][i])
                b.append(s[x:y][j])
            a, b = np.concatenate(a), np.concatenate(b)
            found = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1]))[0]
            if held and last == 0 and all(c[0] == h[-1] for c, h in zip(now[:3], held[-1][:3], strict=True)):
                held.append(now)  # one list so far
                continue
            held.append([c[:last] for c in now])
            if sum(len(h[0]) for h in held):
                yield from passed([np.concatenate(c) for c in zip(*held, strict=True)])
            held = [[c[last:] for c in now]]
        if held:
            yield from passed([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def derived(sets: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) that join all groups that ``pairs`` join: of leaders where these link, of pairs that leaders leave open."""
    of = lambda x: labels.select(F.col("s").alias(x), F.col("leader").alias(f"leader_{x}"), F.col("apart").alias(f"apart_{x}"), F.col("n").alias(f"n_{x}"))
    led = checkpointed(pairs.join(of("a"), "a").join(of("b"), "b").where("leader_a <> leader_b"))
    leaders = checkpointed(led.select(F.least("leader_a", "leader_b").alias("a"), F.greatest("leader_a", "leader_b").alias("b")).distinct())
    known = checkpointed(compared(sets, leaders))
    open_ = led.withColumns({"x": F.least("leader_a", "leader_b"), "y": F.greatest("leader_a", "leader_b")}).join(known.where("NOT linked").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("apart").alias("apart_xy")), ["x", "y"])
    # sets that link lie at most (n_a + n_b) (100 - PERCENT) / (100 + PERCENT) apart, and distances are a metric
    reach = (100 + PERCENT) * (F.col("apart_xy") - F.col("apart_a") - F.col("apart_b")) <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b"))
    left = checkpointed(open_.where(reach).select("a", "b"))
    return known.where("linked").select("a", "b").unionByName(compared(sets, left).where("linked").select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(id, group): the smallest id that each linked id reaches, by alternating star contraction."""

    def size_of(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = size_of(edges)
    while True:
        # large star: neighbours greater than u point to the smallest of u's neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: u and its smaller neighbours point to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges = checkpointed(small)
        after = size_of(edges)
        if after == before:
            stars = edges.select(F.col("a").alias("id"), F.col("b").alias("group"))
            return stars.unionByName(stars.select(F.col("group").alias("id"), "group").distinct())
        before = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = checkpointed(named(source))
    texts = rows.where("slot IS NULL")
    known = texts.where("id IS NOT NULL AND n > 0").select("id", "s")
    total = texts.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))
    sets = checkpointed(shared_sets(source, heavy_counters(rows, total), parts))
    labels = checkpointed(sets.select("s", "n", F.col("s").alias("leader"), F.lit(0).cast("bigint").alias("apart")))
    # an id with several rows may stand for several sets, which are one document
    several = known.groupBy("id").agg(F.min("s").alias("b"), F.max("s").alias("high")).where("b <> high").select("id", "b")
    links = checkpointed(known.join(several, "id").select(F.col("s").alias("a"), "b").where("a <> b"))
    for turn in range(TURNS):
        found = checkpointed(compared(sets, checkpointed(leader_pairs(sets, labels, turn))).where("linked"))
        links = links.unionByName(found.select("a", "b"))
        # a set without a leader gets the turn's; whom its leader follows by then doesn't matter to distances
        next_ = found.select(F.col("a").alias("s"), F.col("b").alias("new"), F.col("apart").alias("far"))
        led = labels.join(next_, "s", "left")
        free = (F.col("leader") == F.col("s")) & F.col("new").isNotNull()
        labels = checkpointed(led.select("s", "n", F.when(free, F.col("new")).otherwise(F.col("leader")).alias("leader"), F.when(free, F.col("far")).otherwise(F.col("apart")).alias("apart")))
    groups = components(links)
    pairs = checkpointed(index_pairs(sets, groups))
    more = derived(sets, labels, pairs)
    groups = components(groups.select(F.col("id").alias("a"), F.col("group").alias("b")).unionByName(more))
    least = known.groupBy("s").agg(F.min("id").alias("least"))
    # sets without a link are most; they stay out of the joins by group
    grouped = groups.withColumnRenamed("id", "s").join(least, "s")
    ids = grouped.groupBy("group").agg(F.min("least").alias("of_group"))
    of_set = least.join(grouped.join(ids, "group").select("s", "of_group"), "s", "left").select("s", F.coalesce("of_group", "least").alias("component"))
    # texts without words have no set; a key of their own spreads them
    found = texts.select("id", "n", F.when(F.col("n") > 0, F.col("s")).otherwise(F.xxhash64("id")).alias("s")).join(of_set, "s", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
