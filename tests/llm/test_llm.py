"""Each operator against a brute-force version, and its defined results on nulls, empty and repeated rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlight.llm import fingerprints, jaccard_join, language_id, line_dedup, mixing, packing, quality_classifier, quality_rules, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "clash", 1.0) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, long, repeated and tied rows, and extra columns whose names clash."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = text(60)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, same, "en", "a"), (4, same, "en", "a"), (5, same, "de", "b"), (6, "one", "de", None), (7, text(40_000), "en", "b"), (8, "12345 !!", "en", "c"), (9, text(55) + "\n" + same, "de", "c"), (None, text(80), "en", "a"), (10, "x" * 200_000, "de", "a")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def spans_brute(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_secrets():
    rng, words = random.Random(1), secret_scan.automaton()
    parts = ["password", "PassWD", "token=", "secret: ", "api_key", "apikey", "APIKEY = '", '"', "=", ":", " ", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "deadbeef", "abcdEFGH1234+/x", "é", "ſecret", "K", "\n", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in secret_scan.spans_of(text, words) if s[2] in secret_scan.BASE_KINDS] == spans_brute(text)
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + secret_scan.base62_checksum(body)
    assert secret_scan.spans_of(f"x {good}.", words) == [(2, 42, "github")]
    assert secret_scan.spans_of(f"x {good[:-1]}_.", words) == [] and secret_scan.spans_of("ghp_" + body + "000000", words) == []


def test_secrets_odd(odd, none):
    got = secret_scan.scan_secrets(odd)
    assert got.count() == odd.count() and got.where(F.size("spans") > 0).count() == 0 and secret_scan.scan_secrets(none).count() == 0


def test_packing_ids_and_places(spark, docs):
    import pandas as pd
    from tokenizers import Tokenizer

    got = packing.pack(docs).toPandas()
    t = Tokenizer.from_file(packing.default_tokenizer())
    by = {k: g.sort_values("piece") for k, g in got.groupby("doc_id")}
    for r in docs.collect():
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 2]
        g = by[r["doc_id"]]
        assert list(g["start"]) == [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)] and g["length"].sum() == len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))
    check_places(got)
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) * 1.02 + 1
    assert isinstance(got, pd.DataFrame)


def check_places(got):
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024


def test_packing_odd(odd, none):
    got = packing.pack(odd).toPandas()
    check_places(got)
    assert got[got.doc_id == 1]["length"].tolist() == [1] and len(got[(got.doc_id == 4) & (got.piece == 0)]) == 2 and packing.pack(none).count() == 0
    encode = packing.Encoder(packing.default_tokenizer())
    for text in ["a  b", " x", "<|endoftext|> y", "it's  'em", "é　ü", None]:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_sum_of_squares_is_the_smallest_choice():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 17, 120)
    sequence, offset = packing.sum_of_squares(lengths, 16)
    fill: dict[int, int] = {}
    squares = lambda f: sum(v * v for g, v in collections.Counter(16 - x for x in f.values()).items() if g)
    for s, k, at in zip(lengths, sequence, offset, strict=True):
        options = [squares(fill | {b: fill.get(b, 0) + s}) for b in [*fill, max(fill, default=-1) + 1] if fill.get(b, 0) + s <= 16]
        assert at == fill.get(k, 0)
        fill[int(k)] = fill.get(int(k), 0) + int(s)
        assert squares(fill) == min(options)


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) or i == j:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def test_jaccard_components(spark):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 400)}"
            rows.append((len(rows) * 7 % 1009, " ".join(copy).upper() if g % 2 else " ".join(copy)))
    rows += [(2000, ""), (2001, None), (2002, "  ")]
    got = jaccard_join.near_duplicates(table(spark, [(i, t, None, None) for i, t in rows]))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in got.collect()} == {i: len(shingle_set(t)) for i, t in rows}


def test_jaccard_odd(odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (None, None)} <= got and jaccard_join.near_duplicates(none).count() == 0


def passages_and_copies():
    """Sixty near copies of one text, thirty texts that share a passage, and ten chains of texts that link one by one."""
    rng = random.Random(4)
    word = lambda: f"u{rng.randint(0, 10**9)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(150)] = word()
        rows.append(copy)
    rows += [[word() for _ in range(100)] + passage + [word() for _ in range(100)] for _ in range(30)]
    for _ in range(10):
        chain = [word() for _ in range(100)]
        for k in range(6):
            chain = [*chain[: 12 * k], *[word() for _ in range(6)], *chain[12 * k + 6 :]]
            rows.append(chain)
    return [(i * 31 % 1009, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 4])
def test_jaccard_lists_in_parts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = passages_and_copies()
    got = jaccard_join.near_duplicates(table(spark, [(i, t, None, None) for i, t in rows]))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(rows)


def test_jaccard_candidates(spark, monkeypatch):
    """What is compared grows with the sets, not with the pairs of a group: 60 near copies have 1770 pairs, 30 texts with a passage 435."""
    counts = collections.Counter()
    compared = jaccard_join.compared

    def counted(sets, pairs):
        counts["pairs"] += pairs.count()
        counts["sets"] = sets.count()
        return compared(sets, pairs)

    monkeypatch.setattr(jaccard_join, "compared", counted)
    rows = passages_and_copies()
    jaccard_join.near_duplicates(table(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert counts["sets"] < 125 and counts["pairs"] < 3 * counts["sets"]


def test_size_and_position_filters_lose_nothing():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = set(rng.integers(0, 60, rng.integers(1, 40)).tolist())
        b = a ^ set(rng.integers(0, 60, rng.integers(0, 6)).tolist())
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        x, y = sorted(a), sorted(b)
        px, py = x[: jaccard_join.prefix_length(len(x))], y[: jaccard_join.prefix_length(len(y))]
        shared = sorted(set(px) & set(py))
        assert shared
        first = shared[0]
        (n1, i), (n2, j) = sorted([(len(x), x.index(first)), (len(y), y.index(first))])
        left, right = jaccard_join.list_pairs(np.array([n1, n2]), np.array([i, j]), np.array([0, 1]))
        assert left.tolist() == [0] and right.tolist() == [1]


def test_block_skipping_is_the_plain_filter():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 300):
        n = np.sort(rng.integers(5, 60, size))
        at = (rng.random(size) * (n * 0.2 + 1)).astype(np.int64)
        group, side = rng.integers(0, 5, size), rng.integers(0, 2, size)
        for own in (None, side):
            i, j = jaccard_join.list_pairs(n, at, group, own)
            want = {(x, y) for x in range(size) for y in range(x + 1, size) if group[x] != group[y] and 100 * n[x] >= 80 * n[y] and 180 * min(n[x] - at[x], n[y] - at[y]) >= 80 * (n[x] + n[y]) and (own is None or own[x] != own[y])}
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_language(spark, docs, odd, none):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(big, fold != 0)
    got = language_id.identify(big.where(fold == 0), model, keep=["doc_id", "lang"])
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() and got.where("score < 0 OR score > 1").count() == 0
    by = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model).collect()}
    assert len(by) == 11 and by[1] == by[2] == by[3] == by[8] == "und" and by[7] != "und"
    assert language_id.identify(none, model).count() == 0 and language_id.fit(none, fold != 0) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_kernel_counts_shared_grams():
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    texts = ["abcab", "xabc", "zz"]
    x = language_id.presence(texts)
    k = language_id.kernel(x, x)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            expected = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
            assert abs(k[i, j] - expected) < 0.02


def base_rules(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] >= 2 for k in range(i, i + 3)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_rules(docs, odd, none):
    for df in (docs, odd):
        known = quality_rules.references(df)
        texts = sorted(map(str, (base_rules(r["text"]) for r in df.collect())))
        got = quality_rules.apply_rules(df, known).collect()
        assert texts == sorted(str((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in got)
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.apply_rules(none, quality_rules.references(none)).count() == 0


def test_references_by_definition(spark, monkeypatch):
    """Counts of each language and of all, words that begin with a null character included; small languages have none of their own."""
    monkeypatch.setattr(quality_rules, "REFERENCE_WORDS", 40)
    rng = random.Random(2)
    vocabulary = ["\x000", "\x00n", "*", *[f"w{k}" for k in range(90)]]
    rows = [(i, " ".join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=rng.randint(0, 30))), rng.choice(["en", "de", None, "*"]) if i else "rare", "a") for i in range(60)]
    known = quality_rules.references(table(spark, rows))
    assert set(known) == {"en", "de", "*", None}
    for lang, (classes, place, common) in known.items():
        texts = [t for _, t, g, _ in rows if lang is None or g == lang]
        counts = collections.Counter(quality_rules.normal(w) for t in texts for w in quality_rules.words_of(t))
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]
        assert list(place) == [w for w, _ in top] and common.tolist() == [*[n for _, n in top], sum(counts.values()) - sum(n for _, n in top)]
        assert classes.tolist() == sum(quality_rules.class_counts(t) for t in texts).tolist()
    # verdicts by the distances' definition
    for _, text, lang, _ in rows + [(0, " ".join(["zz"] * 30 + ["yy", "xx", "vv"] * 9 + [f"q{k}" for k in range(30)]), "en", "a")]:
        n, *_, failed, kept, by_class, by_word = quality_rules.judge(text, lang, known)
        if n >= quality_rules.MIN_WORDS:
            classes, place, common = known.get(lang) or known[None]
            own = np.zeros(len(common))
            for w in quality_rules.words_of(text):
                own[place.get(quality_rules.normal(w), len(common) - 1)] += 1
            for got, p, q in ((by_class, quality_rules.class_counts(text), classes), (by_word, own, common)):
                p, q = p / p.sum(), q / q.sum()
                m = (p + q) / 2
                want = sum(x * np.log2(x / z) for x, z in zip(p, m, strict=True) if x) / 2 + sum(x * np.log2(x / z) for x, z in zip(q, m, strict=True) if x) / 2
                assert abs(got**2 - want) < 1e-9
            assert kept == (not failed and by_class <= quality_rules.MAX_CLASS_DISTANCE and by_word <= quality_rules.MAX_WORD_DISTANCE)
        else:
            assert failed and not kept


def test_divergence():
    assert quality_rules.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and quality_rules.divergence(np.array([2.0, 6]), np.array([1.0, 3])) == 0


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def scored(spark, module, label, modulus, held):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    got = module.score(docs, model).join(labels, "doc_id").where(fold == held).select("score", label).toPandas()
    return model, auc(got["score"].to_numpy(), got[label].to_numpy())


def test_quality_classifier(spark, odd, none):
    model, area = scored(spark, quality_classifier, "quality", 5, 0)
    assert area > 0.95
    got = quality_classifier.score(odd, model)
    assert got.count() == odd.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.fit(odd, labels) is None and {r[0] for r in quality_classifier.score(odd, None).select("score").collect()} == {0.5}
    assert quality_classifier.score(none, model).count() == 0


def test_contexts_pooling_and_forward_pass(spark):
    texts = ["a b c", "b a a d", "", None, "c"]
    words = quality_classifier.contexts(table(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    at, sign = quality_classifier.index_vectors()
    slot = lambda w: zlib.crc32(w.encode()) & (quality_classifier.SLOTS - 1)
    want = np.zeros((quality_classifier.SLOTS, quality_classifier.DIMENSIONS))
    for t in texts:
        w = (t or "").split()
        for i, x in enumerate(w):
            for j, y in enumerate(w):
                if 0 < abs(i - j) <= quality_classifier.WINDOW:
                    for e in range(quality_classifier.ENTRIES):
                        want[slot(x), at[slot(y), e]] += sign[slot(y), e]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(words, want / np.maximum(norm, 1e-9), atol=1e-6)
    got = quality_classifier.pooled(texts, words)
    for row, t in zip(got, texts, strict=True):
        v = np.array([words[slot(x)] for x in (t or "").split()])
        assert np.allclose(row, np.r_[v.mean(0), v.std(0)] if len(v) else 0, atol=1e-4)
    rng = np.random.default_rng(1)
    layers = [rng.normal(size=s) for s in ((128, 5), (5,), (5, 1), (1,))]
    hidden = [[np.tanh(sum(got[r, i] * layers[0][i, j] for i in range(128)) + layers[1][j]) for j in range(5)] for r in range(5)]
    assert np.allclose(quality_classifier.logits(got, layers), [sum(h[j] * layers[2][j, 0] for j in range(5)) + layers[3][0] for h in hidden], atol=1e-5)


def test_toxicity(spark, odd, none):
    model, area = scored(spark, toxicity, "toxic", 4, 2)
    assert area > 0.93
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels) is None and {r[0] for r in toxicity.score(odd, None).select("score").collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def maximal(w):
    """The definition: the best segment, then again left and right of it."""
    best = None
    for a in range(len(w)):
        total = 0.0
        for b in range(a, len(w)):
            total += w[b]
            if total > 0 and (best is None or total > best[2] or total == best[2] and b - a < best[1] - best[0] - 1):
                best = (a, b + 1, total)
    if best is None:
        return []
    shift = lambda part, by: [(a + by, b + by, s) for a, b, s in part]
    return maximal(w[: best[0]]) + [best] + shift(maximal(w[best[1] :]), best[1])


def test_decay_is_the_root_of_the_law():
    rng = np.random.default_rng(4)
    for _ in range(20):
        values, counts = np.r_[-0.04, rng.uniform(-1, 6, 5)], np.r_[10_000, rng.integers(1, 20, 5)].astype(float)
        x = toxicity.decay_of(values, counts)
        if values @ counts < 0 < values.max():
            assert x > 0 and abs(counts @ np.exp(x * values) / counts.sum() - 1) < 1e-6
    # odds of two distributions, untouched: the decay is 1
    p, q = np.array([0.7, 0.2, 0.1]), np.array([0.2, 0.3, 0.5])
    assert abs(toxicity.decay_of(np.log(q / p), p) - 1) < 1e-6 and toxicity.decay_of(np.array([1.0]), np.array([1.0])) == 1
    sample = rng.gumbel(2.5, 1, 20_000)
    assert abs(toxicity.gumbel_level(sample) - 2.5) < 0.05


def test_log_odds_by_definition():
    rng = np.random.default_rng(6)
    toxic, other, prior = (rng.integers(0, 60, 40).astype(float) for _ in range(3))
    odds, z = toxicity.log_odds(toxic, other, prior)
    every = prior + toxic + other + 0.01
    for k in range(40):
        alpha = toxicity.PRIOR_WEIGHT * every[k] / every.sum()
        a, b = toxic[k] + alpha, other[k] + alpha
        n, m = toxic.sum() + toxicity.PRIOR_WEIGHT, other.sum() + toxicity.PRIOR_WEIGHT
        value = np.log(a / (n - a)) - np.log(b / (m - b))
        if abs(value / np.sqrt(1 / a + 1 / b)) < toxicity.LEAST_Z:
            assert odds[k] == z[k] == 0
        else:
            assert abs(odds[k] - min(max(value, -1), toxicity.CLIP)) < 1e-9


def test_segments():
    rng = np.random.default_rng(8)
    for _ in range(300):
        w = rng.normal(-0.2, 1, rng.integers(0, 25))
        got, want = toxicity.maximal_segments(w), maximal(w)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def filled(sizes, weights, total):
    """Targets by handing out what is left again and again."""
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), total
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left, free = left - sum(2.0 * sizes[s] for s in full), free - full
    return target


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        got = mixing.mix(df).toPandas()
        again = mixing.mix(df).toPandas()
        key = ["doc_id", "size", "taken"]
        assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
        sizes = got.groupby("source", dropna=False)["size"].sum().to_dict()
        sizes = {(None if s != s else s): int(n) for s, n in sizes.items()}
        names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
        want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
        for s, g in got.groupby("source", dropna=False):
            s = None if s != s else s
            assert abs(g["target"].iloc[0] - want[s]) < 1e-6 and (g["source_size"] == sizes[s]).all()
            assert abs(g["taken"].sum() - want[s]) <= g["size"].max() / 2 + 1
        assert (got["taken"] <= 2 * got["size"]).all()
        assert sorted(got["size"]) == sorted(len(WORD.findall(r["text"] or "")) for r in df.collect())
    assert mixing.mix(none).count() == 0


def test_mixing_keeps_few_files(spark, docs, odd, monkeypatch):
    """One table of rows is kept, and one file for all sources; many sources, which meet the rows by a shuffle, have the same mix."""
    context, confs = spark.sparkContext, {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = lambda: {f for d, _, names in os.walk(context.getCheckpointDir().removeprefix("file:")) for f in (f"{d}/{n}" for n in names if n.startswith("part-"))}
    mixing.checkpointed(spark.range(1))
    before, were = kept(), {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        few = [sorted(map(str, mixing.mix(df).collect())) for df in (docs, odd)]
        assert 0 < len(kept() - before) <= 2 * (23 + 1)
        monkeypatch.setattr(mixing, "FEW", 0)
        assert [sorted(map(str, mixing.mix(df).collect())) for df in (docs, odd)] == few
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)


def test_mixing_draws_as_odds_say(spark):
    """Documents of a size are taken as often as their solved inclusion probability; sizes that would pass 1, always."""
    rng = random.Random(12)
    kinds = {5: 3000, 20: 2000, 80: 400, 4000: 4}
    rows = [(i, " ".join(["w"] * n), None, s) for i, (n, s) in enumerate((n, s) for s in "ab" for n, k in kinds.items() for _ in range(k))]
    rng.shuffle(rows)
    got = mixing.mix(table(spark, rows)).toPandas()
    words, docs_ = sum(n * k for n, k in kinds.items()), sum(kinds.values())
    for source, wanted in (("a", 0), ("b", None)):
        g = got[got.source == source]
        wanted = g["target"].iloc[0] - words * (g["target"].iloc[0] // words)
        pull = {n: 0.5 + 0.5 * n * docs_ / words for n in kinds}
        certain: set = set()
        while True:
            scale = (wanted - sum(n * kinds[n] for n in certain)) / sum(pull[n] * n * kinds[n] for n in kinds if n not in certain)
            more = {n for n in kinds if n not in certain and scale * pull[n] >= 1}
            if not more:
                break
            certain.add(max(more))
        extra = (g["taken"] / g["size"]) - g["target"].iloc[0] // words
        for n in kinds:
            share, chance = extra[g["size"] == n].mean(), 1 if n in certain else scale * pull[n]
            assert abs(share - chance) < 4 * (chance * (1 - chance) / kinds[n]) ** 0.5 + 0.02, (source, n, share, chance)


def test_line_dedup(spark, none):
    rng = random.Random(6)
    lines = [f"line number {i} of many words" for i in range(12)] + ["two words", ""]
    rows = [(i, None if i == 50 else "\n".join(rng.choice(lines + [f"own line {i} is here"]) for _ in range(rng.randint(0, 9))), None, rng.choice([None, "a", "b", "c", "d"])) for i in range(60)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_boilerplate(table(spark, rows), 4).collect()}
    sites, holder = collections.defaultdict(set), {}
    for i, t, _, s in rows:
        for x in (t or "").split("\n"):
            if len(x.split()) >= 3:
                sites[x] |= {s} - {None}
                holder.setdefault(x, i)
    for i, t, _, _ in rows:
        if t is None:
            assert got[i] == (None, 0, 0)
            continue
        kept, seen = [], set()
        for x in t.split("\n"):
            if len(sites.get(x, ())) < 4 or holder[x] == i and x not in seen:
                kept.append(x)
            seen.add(x)
        assert got[i] == ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    assert line_dedup.remove_boilerplate(none).count() == 0


def test_line_dedup_odd(odd):
    got = line_dedup.remove_boilerplate(odd, 2)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "n_lines", "n_removed"]


def test_fingerprints(docs, odd, none):
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), reverse=True)
        for k, (i, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
            if edited == text:
                assert got[i]["near_edited"] == 1
        by_text = collections.defaultdict(set)
        for i, text in rows:
            by_text[text].add(got[i]["fingerprint"])
        assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_fingerprints(none).count() == 0 and fingerprints.edited_fingerprints(odd).count() == odd.count()


def test_fingerprints_cover_the_whole_lexicon(spark):
    """Texts that differ by one term in the band, or have none in it but other terms, differ; only texts without terms are empty."""
    long = " ".join(f"rare{k}" for k in range(300))
    texts = [f"term{k} wide" for k in range(120)] + [f"{long} more{k}" for k in range(3)] + ["many few"] * 60 + ["many"] * 60 + [" ?!", ""]
    df = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = sorted(fingerprints.edited_fingerprints(df).collect(), key=lambda r: r["doc_id"])
    # more than one text in e has "many", so it is out of the band
    band = {w for w in {w for t in texts for w in t.split()} if fingerprints.MIN_IDF <= np.log(len(texts) / sum(w in t.split() for t in texts)) <= fingerprints.MAX_IDF}
    assert "many" not in band and {"term0", "more0"} < band
    by_print = collections.defaultdict(set)
    for r, t in zip(got, texts, strict=True):
        by_print[r["fingerprint"]].add(frozenset(re.findall(r"\w+", t)))
    assert all(len(v) == 1 for v in by_print.values()) and by_print[""] == {frozenset()}
    assert all(r["near_next"] == (1 if set(texts[i - 1].split()) == set(texts[i].split()) else 0) for i, r in enumerate(got) if 0 < i < 120 or 125 < i < 243 and i != 183)
    assert 0.8 < got[121]["near_next"] < 1


def fingerprint_brute(texts):
    """Fingerprint of each text by the definition, as {subset: hash}; the lexicon is that of the texts given first."""
    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = lambda t: sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w})

    def together(hashes):
        h = 42
        for x in hashes:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
        return h & ((1 << 55) - 1)

    df = collections.Counter(x for t in texts for x in of(t))
    low, high = len(texts) * np.exp(-fingerprints.MAX_IDF), len(texts) * np.exp(-fingerprints.MIN_IDF)

    def result(text):
        terms = of(text)
        own = [x for x in terms if low <= df[x] <= high]
        if not own:
            return {89: together(terms)} if terms else {}
        subsets = {0: own}
        for k in range(8):
            subsets[1 + k] = [x for x in own if (x >> 2 * k) & 3]
        for k in range(64):
            subsets[9 + k] = [x for x in own if (x >> 58) & 63 == k]
        for k in range(16):
            subsets[73 + k] = [x for x in own if (x >> 20) & 511 == k]
        return {k: together(v) for k, v in subsets.items() if v}

    return result


def test_fingerprints_by_definition(docs):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    of = fingerprint_brute([t for _, t in rows])
    read = lambda text: {(v := int(x, 16)) >> 55: v & ((1 << 55) - 1) for x in text.split(".") if x}
    alike = lambda a, b: sum(a.get(k) == h for k, h in b.items()) / len({*a, *b}) if {*a, *b} else 1.0
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, changed = of(text), of(edited)
        assert read(got[i]["fingerprint"]) == own and read(got[i]["edited_fingerprint"]) == changed
        assert abs(got[i]["near_edited"] - alike(own, changed)) < 1e-9 and abs(got[i]["near_next"] - alike(own, of(after))) < 1e-9


def test_fingerprint_table():
    rng = np.random.default_rng(3)
    found = np.unique(rng.integers(-(1 << 63), 1 << 63, 5000)).tolist()
    held = fingerprints.table_of(found)
    assert all(h in {held[at] for at in fingerprints.places(h, len(held) - 1)} for h in found) and fingerprints.table_of([]) == [0] * 1024


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = packing.checkpointed(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] == counts[2] == counts[0] and counts[3] < counts[2]
    check_places(docs.toPandas())


def test_pipeline_odd(spark, odd):
    """Columns of any name and type go through unchanged."""
    import corpus_pipeline

    more = {"lang_pred": F.lit("mine"), "n_lines": F.lit(-7), "n_removed": F.lit(-8), "copies": F.lit(-9), "id": F.lit("i"), "c0": F.lit("c"), "size": F.create_map(F.lit("k"), F.lit(1)), "row": F.struct(F.lit(2).alias("score"))}
    docs = odd.withColumns(more)
    columns, types = docs.columns, docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        docs = packing.checkpointed(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == types
            assert {tuple(r) for r in docs.select("spans", F.col("score"), "lang_pred", "n_lines", "n_removed", "copies", "id", "c0", F.col("size")["k"], "row.score").collect()} <= {("clash", 1.0, "mine", -7, -8, -9, "i", "c", 1, 2)}
    check_places(docs.toPandas())


def test_pipeline_brute(spark):
    """Each stage's rows from those of the stage before, by definition."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("more", F.col("doc_id") * 2)
    stages = dict(corpus_pipeline.STAGES)
    first = packing.checkpointed(stages["language_id"](spark, docs, SF))
    model = language_id.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    want = {r["doc_id"] for r in language_id.identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    assert {r["doc_id"] for r in first.collect()} == want
    second = packing.checkpointed(stages["line_dedup"](spark, first, SF))
    sites, holder = collections.defaultdict(set), {}
    rows = sorted(first.collect(), key=lambda r: r["doc_id"])
    for r in rows:
        for x in r["text"].split("\n"):
            if len(WORD.findall(x)) >= 3:
                sites[x] |= {r["source"]} - {None}
                holder.setdefault(x, r["doc_id"])
    got = {r["doc_id"]: r for r in second.collect()}
    for r in rows:
        kept, seen = [], set()
        for x in r["text"].split("\n"):
            if len(sites.get(x, ())) < line_dedup.MIN_SITES or holder[x] == r["doc_id"] and x not in seen:
                kept.append(x)
            seen.add(x)
        assert got[r["doc_id"]]["text"] == "\n".join(kept) and got[r["doc_id"]]["more"] == 2 * r["doc_id"]
    third = packing.checkpointed(stages["jaccard_join"](spark, second, SF))
    groups = components([(r["doc_id"], r["text"]) for r in got.values()])
    assert sorted(r["doc_id"] for r in third.collect()) == sorted({g for g in groups.values()})
    fourth = packing.checkpointed(stages["mixing"](spark, third, SF))
    words = {r["doc_id"]: len(WORD.findall(r["text"])) for r in third.collect()}
    by = collections.Counter()
    for r in third.collect():
        by[r["source"]] += words[r["doc_id"]]
    names = sorted(s for s in by if s is not None) + ([None] if None in by else [])
    target = filled(dict(by), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(by.values()))
    taken = collections.Counter()
    for r in fourth.collect():
        taken[r["source"]] += words[r["doc_id"]]
    assert all(abs(taken[s] - target[s]) <= max(words.values()) / 2 + 1 for s in by)
    check_places(stages["packing"](spark, fourth, SF).toPandas())


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op10_line_dedup", "op12_fill_in_middle", "op13_periodic_runs"])
def test_queries_equal_their_sql(spark, name):
    import duckdb
    from strandlight.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(c[0] for c in cursor.description) == columns
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=str)


def test_mixing_rows_alike(spark):
    """Rows of null ids, of one id and alike in all that is read: the pipeline's stage gives what the mix takes of them."""
    import corpus_pipeline

    rng = random.Random(2)
    rows = []
    for k in range(400):
        text = " ".join(["x"] * 3 if rng.random() < 0.5 else [str(rng.randint(0, 9)) for _ in range(rng.choice([3, 10, 50]))])
        rows.append((None if rng.random() < 0.6 else k // 2, text if rng.random() < 0.95 else None, "en", rng.choice(["a", "a", "a", "b", "c", None]), 1, str(k), 0.0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 400 and sorted(map(str, mixed)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 25 for r in mixed)
    hashes = {r["text"]: r["h"] for r in docs.select("text", mixing.digest_of(F.col("text")).alias("h")).collect()}
    want, got = collections.Counter(), collections.Counter()
    for r in mixed:
        want[r["doc_id"], r["source"], r["text_hash"]] += r["copies"]
    found = corpus_pipeline.mixed(spark, docs, SF).collect()
    for r in found:
        got[r["doc_id"], r["source"], hashes[r["text"]]] += 1
    assert got == +want and max(collections.Counter(r["spans"] for r in found).values()) <= 2


def test_folds_of_null_ids(spark, tmp_path):
    """No null id is held out by a query of a learned operator, and none is learned from."""
    from strandlight.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lost = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    odd = lost.withColumn("lang", F.when(F.col("doc_id").isNull(), F.lit("zz")).otherwise(F.col("lang")))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_language_id(spark, str(tmp_path)).collect()
    assert len(found) == docs.count() and not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert "zz" not in {r["lang_pred"] for r in found} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
