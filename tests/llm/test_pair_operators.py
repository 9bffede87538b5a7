from __future__ import annotations

import hashlib
import inspect
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from landgrid.llm import embed_dedup, ngram_join, substring_dedup
from landgrid.llm.common import connected_components


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 3000 + i) for i in range(400)] + [(5000, 5000)]
    want = Sets({x for e in edges for x in e})
    for a, b in edges:
        want.join(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.top(x) for x in want.up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------------------------------------------


def brute_jaccard(rows, n=5, t=0.8):
    sets = {}
    for i, x in rows:
        w = re.findall(r"\w+", (x or "").lower())
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    links, comps = dict.fromkeys(sets, 0), Sets(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= t * (len(sets[a]) + len(sets[b]) - both):
                links[a], links[b] = links[a] + 1, links[b] + 1
                comps.join(a, b)
    return {i: (links[i], comps.top(i)) for i in sets}


def near_copies(rng, words, n, edits):
    return [" ".join(w if rng.random() > edits else f"z{rng.randrange(999)}" for w in words) for _ in range(n)]


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate([None, "", "...", "one two", "One  two!", "a b c d e", "a b c d e f"])]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 400]))]
        rows += [(len(rows) + k, t) for k, t in enumerate([" ".join(base)] * 2 + near_copies(rng, base, 5, 0.015))]
    hot = [f"h{i}" for i in range(90)]
    rows += [(1000 + k, t) for k, t in enumerate(near_copies(rng, hot, 80, 0.012) + [" ".join(hot)] * 60)]
    df = docs(spark, rows).selectExpr("doc_id", "text", "1 as copies", "text as component")
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.jaccard_join(df, block=16).collect()}
    want = brute_jaccard(rows)
    assert got == want and sum(v[0] for v in want.values()) > 5000
    assert ngram_join.jaccard_join(df.limit(0)).count() == 0
    assert ngram_join.jaccard_join(docs(spark, [(None, "a b c d e f g"), (1, "a b c d e f g")])).where("n_links = 1").count() == 2


def test_pruning_keeps_what_may_reach_the_threshold():
    limits = ngram_join.posterior_limits(0.8, 1e-4, 192, 16)
    assert limits == sorted(limits) and 0 < limits[0] < 16 and limits[-1] < 0.8 * 192
    strict = ngram_join.posterior_limits(0.8, 0.5, 192, 16)
    assert all(a >= b for a, b in zip(strict, limits, strict=True))


def test_bands_and_pruning_together_miss_few_pairs():
    given_ = {n: p.default for n, p in inspect.signature(ngram_join.jaccard_join).parameters.items()}
    bands, rows, step = given_["bands"], given_["rows"], 16
    limits = ngram_join.posterior_limits(given_["threshold"], given_["tolerance"], bands * rows // step * step, step)
    for j in (0.8, 0.82, 0.85):
        one = np.array([math.comb(step, m) * j**m * (1 - j) ** (step - m) for m in range(step + 1)])
        chance, pruned = np.ones(1), 0.0
        for limit in limits:
            chance = np.convolve(chance, one)
            pruned += chance[:limit].sum()
            chance[:limit] = 0
        assert pruned + (1 - j**rows) ** bands < 6.5e-5


# -- 9 ---------------------------------------------------------------------------------------------------------------------------------


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), int(c % 3)))
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + rng.standard_normal(16) * 0.02).astype(np.float32).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, [1.0] * 16, 1) for i in range(50)] + [(2100, [2.0] * 16, 1), (2101, [1.0] * 16, 2), (2102, [1.0] * 16, None)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [1.0, None] + [0.0] * 14, 1), (3003, [float("nan")] * 16, 1), (3004, [float("inf")] + [1.0] * 15, 1), (3005, [], 1), (3006, [1.0] * 8, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df, block=32, part_rows=700).collect()}
    good = [(i, np.array(v, float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, comps = dict.fromkeys((r[0] for r in rows), 0), Sets(r[0] for r in rows)
    for x, (i, v, k) in enumerate(good):
        for j, w, m in good[x + 1 :]:
            if k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i], links[j] = links[i] + 1, links[j] + 1
                comps.join(i, j)
    want = {i: (links[i], comps.top(i), comps.top(i) == i) for i, _, _ in rows}
    assert len(got) == len(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found >= 0.99 * there and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i][0] == 0 and got[i][2] for i in (3000, 3001, 3002, 3003, 3004, 3005, 2102))
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_find_isolated_pairs_of_a_label_that_shares_a_direction(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], 500
    for label, n in ((1, 6_000), (2, 1_500)):  # sorted in passes, and compared in blocks
        common, x, u = rng.standard_normal(64), rng.standard_normal((n, 64)), rng.standard_normal((pairs, 64))
        x = np.sqrt(0.95) * common / np.linalg.norm(common) + np.sqrt(0.05) * x / np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a = x[:pairs]
        u -= (u * a).sum(1, keepdims=True) * a
        x[pairs : 2 * pairs] = 0.981 * a + np.sqrt(1 - 0.981**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
        rows += [(label * 10_000 + i, v, label) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in embed_dedup.near_vectors(df).collect()}
    share = {label: np.mean([got[label * 10_000 + i] == got[label * 10_000 + pairs + i] for i in range(pairs)]) for label in (1, 2)}
    assert share[1] >= 0.97 and share[2] == 1.0


def test_passes_grow_with_rows_and_with_what_vectors_share():
    passes = [[embed_dedup.passes_for(n, alike, 0.98, 32, 128, 12, 0.02) for n in (10**5, 10**6, 10**7)] for alike in (0.0, 0.5, 0.8, 0.9)]
    assert passes[0][0] == 12 and all(a <= b for p in passes for a, b in zip(p, p[1:])) and all(a <= b for p, q in zip(passes, passes[1:]) for a, b in zip(p, q))
    assert passes[2][0] < passes[2][1] < passes[2][2] and embed_dedup.passes_for(33, 0.99, 0.98, 32, 128, 12, 0.02) == 1
    assert embed_dedup.passes_for(2_000, 0.98, 0.98, 32, 128, 12, 0.02) == 0


# -- 10 --------------------------------------------------------------------------------------------------------------------------------


def brute_substrings(rows, length):
    first: dict[bytes, int] = {}
    key = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(i), len(b), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def cut_substrings(spark, rows, **options):
    got = substring_dedup.substring_dedup(docs(spark, rows).selectExpr("doc_id", "text", "1 as spans"), **options).collect()
    return sorted((str(r.doc_id), r.n_bytes, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(45, 140))) for _ in range(12)]
    line = "".join(rng.choice("xyz ") for _ in range(53))
    rows = [(None, passages[0] + passages[1]), (3, None), (4, ""), (5, "short"), (6, "a" * 300), (7, "b" + "a" * 200), (8, "ab" * 120), (9, "ab" * 90)]
    for i in range(20, 90):
        parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 90))) for _ in range(3)]
        rows.append((rng.randrange(20, 80), parts[0] + rng.choice(passages) + parts[1] + (line if i % 2 else "") + parts[2] + rng.choice(passages)))
    rows += [(200 + i, rows[12][1]) for i in range(30)]
    assert cut_substrings(spark, rows) == brute_substrings(rows, 50)
    assert cut_substrings(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_tiny_alphabets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), "".join(rng.choice("ab") for _ in range(rng.randrange(0, 120)))) for _ in range(60)]
    assert cut_substrings(spark, rows, length=12, k=6) == brute_substrings(rows, 12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=20, max_size=20), min_size=1, max_size=12), st.integers(4, 12))
def test_suffix_sort_orders_suffixes(rows, length):
    text = np.array([list(r.encode()) for r in rows], np.uint8)
    r = np.repeat(np.arange(len(rows)), 20 - length + 1)
    a = np.tile(np.arange(20 - length + 1), len(rows))
    s = substring_dedup.Suffixes(text, r, a, length)
    group = (r >= len(rows) // 2).astype(np.int64)
    got = s.sort(group)
    cut = [rows[i][j : j + length] for i, j in zip(r, a, strict=True)]
    assert [(group[i], cut[i]) for i in got] == sorted(zip(group.tolist(), cut, strict=True))
    plain = s.merged(np.arange(len(r)), group)
    assert [(group[i], cut[i]) for i in plain] == sorted(zip(group.tolist(), cut, strict=True))


@pytest.mark.parametrize("collide", [False, True])
def test_sorted_suffixes_decide_the_shared_windows(monkeypatch, collide):
    rng = np.random.default_rng(10)
    length, k, n = 50, 24, 400
    reach = length - k
    anchor, doc = np.sort(rng.integers(0, 40, n)).astype(np.uint64), rng.integers(0, 100, n)
    text = rng.integers(97, 123, (40, length + reach)).astype(np.uint8)[anchor.astype(int)]
    left, right = rng.integers(0, reach + 1, n).astype(np.uint8), rng.integers(0, reach + 1, n).astype(np.uint8)
    for row, (x, y) in enumerate(zip(reach - left.astype(int), reach + k + right.astype(int), strict=True)):
        text[row, :x], text[row, y:] = 0, 0
        text[row, rng.integers(0, length + reach)] = rng.integers(97, 123)
    sorted_sizes, real = [], substring_dedup.Suffixes.sort

    def sort(self, group):
        sorted_sizes.append(len(self.r))
        if collide:
            self.whole[:] = 1
        return real(self, group)

    monkeypatch.setattr(substring_dedup.Suffixes, "sort", sort)
    r, a = substring_dedup.shared_windows(anchor, doc, left, right, text, length, k)
    windows = [(i, x) for i in range(n) for x in range(reach - int(left[i]), reach + k + int(right[i]) - length + 1)]
    least = {}
    for i, x in windows:
        key = anchor[i], text[i, x : x + length].tobytes()
        least[key] = min(doc[i], least.get(key, doc[i]))
    want = {(i, x) for i, x in windows if doc[i] > least[anchor[i], text[i, x : x + length].tobytes()]}
    assert set(zip(r.tolist(), a.tolist(), strict=True)) == want and len(want) > 100
    assert sorted_sizes == [len(windows)]


def test_merged_ranges():
    assert substring_dedup.merged(np.array([[5, 9], [0, 3], [3, 4], [8, 12], [20, 21]])).tolist() == [[0, 4], [5, 12], [20, 21]]
    assert substring_dedup.merged(np.zeros((0, 2), int)).tolist() == []


# -- pipeline --------------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(160):
        w = [word() for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), "en", f"s{i % 3}", 1, "extra"))
        labels.append((i, int(not bad), 0))
    rows += [(500 + i, rows[i][1].replace(" ", "  ", 1), "en", "s0", 1, "extra") for i in (1, 2, 3)]
    near = rows[5][1].split()
    rows.append((600, " ".join([*near, "more"]), "en", None, 1, "extra"))
    rows.append((700, None, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long, __copy string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    d0 = spark.read.parquet(f"{sf}/documents.parquet").drop("__copy")
    good = corpus_pipeline.keep_quality(spark, d0, sf)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == d0.columns and not kept & set(range(0, 160, 4)) and {i for i in range(160) if i % 4} <= kept
    once = corpus_pipeline.drop_copies(spark, good, sf)
    assert {r.doc_id for r in once.collect()} == kept - {501, 502, 503}
    far = corpus_pipeline.drop_near_copies(spark, once, sf)
    assert {r.doc_id for r in far.collect()} == kept - {501, 502, 503, 600}
    mixed = corpus_pipeline.mix_sources(spark, far, sf)
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r.doc_id] += 1
    assert mixed.columns == d0.columns and set(counts.values()) <= {1, 2} and set(counts) <= kept
    out = corpus_pipeline.tokenise(spark, mixed, sf).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(out) == sum(counts.values())
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, sf).count() == len(out)
