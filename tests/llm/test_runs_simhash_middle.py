"""Operators 11 to 13 against brute-force versions, and their defined results on nulls, empty, long and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from strandlight.llm import fill_in_middle, periodic_runs, queries, simhash_join

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, output string, fp long, runs string, restored string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    same = " ".join(["alpha", "beta"] * 30)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (4, "other words here"), (5, "one"), (6, "A B İ x\n<P>"), (7, "v w\n" * 30_000), (None, "a b c d"), (None, same), (8, "line\nline two\n\nlast é"), (9, "x" * 200_000)]
    return spark.createDataFrame([(i, t, 7, "clash", 1, "clash", "clash") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# operator 11


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def linked(rows):
    """{(id, fingerprint): smallest id reachable} of rows (id, fingerprint)."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, (o, b) in enumerate(rows[:k]):
            if (a ^ b).bit_count() <= 2 or (i is not None and i == o):
                root[find(k)] = find(j)
    least = collections.defaultdict(set)
    for k, (i, _) in enumerate(rows):
        least[find(k)] |= {i} - {None}
    return sorted(((i, f"{a:016x}", min(least[find(k)], default=None)) for k, (i, a) in enumerate(rows)), key=str)


def test_simhash_of_documents(spark, docs):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    for most in (simhash_join.MOST, 1):
        assert sorted(map(tuple, simhash_join.near_duplicates(docs, most=most).collect()), key=str) == linked(rows)


def test_simhash_odd(odd):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in odd.collect()]
    assert sorted(map(tuple, simhash_join.near_duplicates(odd).collect()), key=str) == linked(rows)
    assert simhash_join.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [256, 4])
def test_links_of_fingerprints(spark, most):
    """Chains of near fingerprints, whose links both ways must join alike: pair by pair, and by neighbours."""
    rng = random.Random(most)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    links = [tuple(v % (1 << 64) for v in r) for r in simhash_join.fingerprint_links(nodes, most).collect()]
    # pair by pair a link is two bits at most; by neighbours so are all of one place, which differ from it in one
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    want = linked(list(enumerate(prints)))
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for x in prints:
        groups[find(x)].add(f"{x:016x}")
    other = collections.defaultdict(set)
    for _, x, c in want:
        other[c].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values())) and len(other) < len(prints)


def test_every_link_has_a_chain_in_its_budgets():
    """Pigeonring: two bits anywhere leave two neighbouring segments equal and all longer chains from there in their budgets."""
    masks = simhash_join.segment_masks()
    assert sum(masks) == (1 << 64) - 1
    for i in range(64):
        for j in range(i + 1):
            differ = (1 << i) | (1 << j)
            sums = lambda c, n: sum((differ & masks[(c + k) % 5]).bit_count() for k in range(n))  # noqa: E731, B023
            assert any(all(sums(c, n) <= n * 2 / 5 for n in range(1, 6)) for c in range(5))


# operator 12


def middle(i, text, rate=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def test_middle_of_documents(spark, docs):
    want = sorted((r["doc_id"], *(m := middle(r["doc_id"], r["text"]))[:4], sha(m[4]), sha(r["text"] or "")) for r in docs.collect())
    assert sorted(map(tuple, queries.op12_fill_in_middle(spark, SF).collect())) == want


def test_middle_odd(odd):
    found = fill_in_middle.fill_in_middle(odd, rate=60, suffix_first=30)
    got = sorted((tuple(r) for r in fill_in_middle.restored(found).collect()), key=str)
    assert got == sorted(((r["doc_id"], *middle(r["doc_id"], r["text"], 60, 30), r["text"] or "") for r in odd.collect()), key=str)
    assert fill_in_middle.restored(fill_in_middle.fill_in_middle(odd.limit(0))).count() == 0


def test_marks_over_borders_restore():
    """Parts that end or begin with pieces of marks, many texts to a batch, batches cut anywhere."""
    rng = random.Random(1)
    pieces = ["a", "é", "\n", "<", "S>", "<P", "P>", "<M>", "　x", "\r", "a\n"]
    for _ in range(300):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        h = np.array([[rng.getrandbits(32) for _ in texts] for _ in range(4)])
        data, bounds = fill_in_middle.bytes_of(pa.array(texts, pa.string()))
        made, out, _, form, _, _ = fill_in_middle.transform(data, bounds, h)
        back, at = fill_in_middle.inverse(made, out, form)
        assert [back[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [t or "" for t in texts]


# operator 13


def runs_brute(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        k = rng.choice([1, 2, 2, 3, 4])
        w = [rng.randint(1, k) for _ in range(rng.randint(1, 40))]
        assert [tuple(r) for r in periodic_runs.runs_in(w).tolist()] == runs_brute(w, 2, 2)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = []
            for _ in range(rng.randint(0, 6)):
                unit = [b"%d" % rng.randint(1, rng.choice([2, 6, 50])) for _ in range(rng.randint(1, 8))]
                w += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
            texts.append(w)
        for least, times in ((6, 4), (2, 2), (10, 3)):
            for w, found in zip(texts, periodic_runs.runs_of(texts, least, times), strict=True):
                assert [tuple(r) for r in found.tolist()] == runs_brute(w, least, times)


def test_extensions_equal_a_comparison():
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.randint(1, 2) for _ in range(rng.randint(2, 90))]
        tree = periodic_runs.SuffixTree(w)
        assert [w[i:] for i in tree.order] == sorted(w[i:] for i in range(len(w) + 1))
        pairs = [(i, j) for i in range(len(w)) for j in range(len(w)) if i != j]
        common = lambda i, j: next((k for k in range(len(w) - max(i, j)) if w[i + k] != w[j + k]), len(w) - max(i, j))  # noqa: E731, B023
        assert tree.extension(*np.array(pairs).T).tolist() == [common(i, j) for i, j in pairs]


def collapsed_brute(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_documents(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    with_run = 0
    for r in docs.collect():
        w, h = WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = runs_brute(w, 6, 4)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert got[r["doc_id"]] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(collapsed_brute(w, runs)))
        with_run += bool(runs)
    assert with_run > 5


def test_runs_odd(odd):
    rows = sorted((tuple(r) for r in periodic_runs.periodic_runs(odd).collect()), key=str)
    want = []
    for r in odd.collect():
        w = WORD.findall(r["text"] or "")
        runs = [(0, 60_000, 2)] if r["doc_id"] == 7 else runs_brute(w, 6, 4)
        want.append((r["doc_id"], len(w), runs, collapsed_brute(w, runs)))
    assert rows == sorted(want, key=str) and periodic_runs.periodic_runs(odd.limit(0)).count() == 0
