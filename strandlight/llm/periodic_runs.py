"""Periodic runs of words by longest common extensions on suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping it. For each stretch that may
hold a run two suffix trees are built by Ukkonen's algorithm, of its words and of their reversal, and an Euler tour of
each, on which the least depth between two leaves is that of their lowest common ancestor, the length of their common
extension, in constant time. The order of the leaves gives, for the order of the words and for its reverse, the longest
Lyndon word at each place. By the runs theorem every run has such a word as root, so these at most two candidates a place
are extended in both directions, and those that reach twice their period are the runs, each with its smallest period.

Only runs of at least ``least`` words and ``times`` periods are wanted, and these can only lie in stretches whose k-grams recur
nearby: in such a run each k-gram recurs q words before or after (``gram`` gives the k), and q is at most a ``times``-th of
the stretch. So places that no such k-gram covers are left out before trees are built, and again until nothing more
falls out. A run that ends at a border of what is left ends there in the whole text too, so nothing is lost or added.
k-grams are compared by hashes, where a collision only leaves more to the trees; words are compared as they are.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text; runs may overlap; a word goes
from the collapsed text if any run holds it after its first period; rows of equal id or text stand for themselves; an
empty table gives an empty table; columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import batches

#: Wanted runs have at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Steps of an Euler tour that are summed up in its table of minima.
BLOCK = 16
#: Pairs whose extensions are looked up together.
LOOKUPS = 1 << 16


def gram(least: int, times: int) -> int:
    """The greatest k such that in every wanted run each k-gram recurs a period before or after.

    One that doesn't has fewer than q places before it and after its k words, so its run has at most 2 q + k - 2 words.
    """
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 2)))


class SuffixTree:
    """Ukkonen's tree of ``words``, numbers from 1 on, with 0 appended as an end of its own, and its Euler tour."""

    def __init__(self, words: list[int]):
        self.size = len(words) + 1
        parent_of, symbol_of, begin, end = self._grown([*words, 0])
        self._tour(parent_of, symbol_of, np.array(end) - np.array(begin))

    @staticmethod
    def _grown(w: list[int]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        n, wide = len(w), max(w) + 1
        begin, end, link, child = [0], [0], [0], {}
        node = edge = length = left = 0
        for i, c in enumerate(w):
            above = 0
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * wide + w[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if above:
                        link[above] = node
                    above = node
                else:
                    start = begin[below]
                    span = min(end[below], i + 1) - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if w[start + length] == c:
                        if above:
                            link[above] = node
                        length += 1
                        break
                    split = len(begin)
                    begin += [start, i]
                    end += [start + length, n]
                    link += [0, 0]
                    child[key] = split
                    child[split * wide + c] = split + 1
                    begin[below] = start + length
                    child[split * wide + w[start + length]] = below
                    if above:
                        link[above] = split
                    above = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        keys, nodes = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(nodes)
        return keys[order] // wide, keys[order] % wide, begin, end

    def _tour(self, parent: np.ndarray, symbol: np.ndarray, span: np.ndarray) -> None:
        """Depths along the tour, the place of each suffix in it, and the suffixes in order."""
        kids = np.lexsort((symbol, parent))
        first = np.searchsorted(parent[kids], np.arange(len(parent) + 2)).tolist()
        kids, span = (kids + 1).tolist(), span.tolist()
        last = first[1:]
        depth = [0] * (len(parent) + 1)
        tour, place, self.order = [], [0] * self.size, []
        path = [0]
        while path:
            node = path[-1]
            tour.append(depth[node])
            at = first[node]
            if at < last[node]:
                first[node] = at + 1
                below = kids[at]
                depth[below] = depth[node] + span[below]
                path.append(below)
                continue
            path.pop()
            if node and last[node - 1] == last[node]:  # a leaf
                suffix = self.size - depth[node]
                place[suffix] = len(tour) - 1
                self.order.append(suffix)
        self.place = np.array(place)
        blocks = np.concatenate([np.array(tour), np.full(-len(tour) % BLOCK, tour[-1])]).reshape(-1, BLOCK)
        self.blocks = blocks
        self.upto = np.minimum.accumulate(blocks, 1).reshape(-1)
        self.onward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        self.levels = [blocks.min(1)]
        while 2 ** len(self.levels) <= len(blocks):
            least, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(least[:-half], least[half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and at ``j``, two different places, have in common."""
        return np.concatenate([np.zeros(0, np.int64), *(self._least(self.place[i[a : a + LOOKUPS]], self.place[j[a : a + LOOKUPS]]) for a in range(0, len(i), LOOKUPS))])

    def _least(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.minimum(x, y), np.maximum(x, y)
        p, q = x // BLOCK, y // BLOCK
        out = np.minimum(self.onward[x], self.upto[y])
        same = np.flatnonzero(p == q)
        at = np.arange(BLOCK)
        inside = (at >= (x[same] % BLOCK)[:, None]) & (at <= (y[same] % BLOCK)[:, None])
        out[same] = np.where(inside, self.blocks[p[same]], self.size).min(1)
        far = np.flatnonzero(q - p > 1)
        between = q[far] - p[far] - 1
        level = np.frexp(between.astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = far[level == k]
            out[own] = np.minimum(out[own], np.minimum(self.levels[k][p[own] + 1], self.levels[k][q[own] - (1 << int(k))]))
        return out


def lyndon_lengths(order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the longest Lyndon words at each place, in the order of the words and in its reverse.

    They reach to the next suffix that is less, or greater; the end, least of all, is the last place.
    """
    n = len(order) - 1
    rank = [0] * (n + 1)
    for r, suffix in enumerate(order):
        rank[suffix] = r
    less, more = [0] * n, [0] * n
    low, high = [n], [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[low[-1]] > r:
            low.pop()  # the end stays, as nothing is less
        less[i] = low[-1] - i
        low.append(i)
        while high and rank[high[-1]] < r:
            high.pop()
        more[i] = (high[-1] if high else n + 1) - i
        high.append(i)
    return np.array(less, np.int64), np.array(more, np.int64)


def runs_in(words: list[int], least: int = 2, times: int = 2) -> np.ndarray:
    """Rows (start, length, period) by start and period of the runs of ``words``, numbers from 1 on."""
    n = len(words)
    forward, backward = SuffixTree(words), SuffixTree(words[::-1])
    at = np.tile(np.arange(n), 2)
    period = np.concatenate(lyndon_lengths(forward.order))
    inside = at + period < n  # a root that ends with the text has its run's other roots before it
    at, period = at[inside], period[inside]
    right = forward.extension(at, at + period)
    left = backward.extension(n - at, n - at - period)
    start, length = at - left, left + period + right
    good = (length >= np.maximum(2, times) * period) & (length >= least)
    found = np.unique(np.column_stack([start, period, length])[good], axis=0)
    return found[:, [0, 2, 1]]


def stretches(words: np.ndarray, doc: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches that may hold wanted runs; ``words`` of several texts, ``doc`` the text of each word."""
    k = gram(least, times)
    none = np.zeros(0, np.int64)
    if len(words) < k:
        return none, none
    h = doc[: len(words) - k + 1].astype(np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i].astype(np.uint64)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[: len(h)] == doc[k - 1 :])
    while True:
        at = at[np.argsort(h[at], kind="stable")]
        gap = np.diff(at)
        gap = np.where(h[at[1:]] == h[at[:-1]], gap, len(words))
        near = np.minimum(np.append(len(words), gap), np.append(gap, len(words)))[: len(at)]
        order = np.argsort(at)
        at, near = at[order], near[order]
        # k-grams that overlap or touch, of one text, cover one stretch
        new = np.append(True, (np.diff(at) > k) | (np.diff(doc[at]) != 0))[: len(at)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        size = at[last[: len(first)]] + k - at[first]
        stays = near * times <= size[np.cumsum(new) - 1]
        if stays.all():
            return at[first], size
        at = at[stays]


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The wanted runs of each of ``texts``, given as words."""
    known: dict[bytes, int] = {}
    flat = np.array([known.setdefault(w, len(known) + 1) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    doc, base = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for start, size in zip(*stretches(flat, doc, least, times), strict=True):
        own = np.unique(flat[start : start + size], return_inverse=True)[1] + 1
        if len(rows := runs_in(own.tolist(), least, times)):
            rows[:, 0] += start - base[doc[start]]
            found[doc[start]].append(rows)
    return [np.concatenate([np.zeros((0, 3), np.int64), *f]) for f in found]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those that a run holds after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(steps)[:-1] == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id_col, n, runs, collapsed) of each row of ``docs``; runs by start, then period."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.large_string())])

    def listed(runs: list[np.ndarray]) -> pa.Array:
        rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        ends = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], fields=list(run_type)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                words = [(t or "").encode().split() for t in texts[a:b]]
                found = runs_of(words, least, times)
                short = [collapsed(w, r).decode() for w, r in zip(words, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(w) for w in words], pa.int64()), listed(found), pa.array(short, pa.large_string())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, "id bigint, n bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
