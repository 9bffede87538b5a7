from __future__ import annotations

import base64
import hashlib
import re
import time

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landgrid.llm import bpe, exact_dedup, html_extract, licenses, mixing, quality, token_files
from landgrid.llm.queries import BPE_PATTERN, BPE_RANKS, END_OF_DOCUMENT
from landgrid.scratch import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# -- 1 ---------------------------------------------------------------------------------------------------------------------------------

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, sorted({x for _, x in found})


ODD = [None, "", "MIT license", "the mit licenseé", "x MIT-License, Apache\nLicense general PUBLIC license", "mit license mit license", "General public", "licença ΜIT license apache license", "a" * 5000]


@pytest.mark.parametrize("text", ODD)
def test_phrases_equal_brute_force(text):
    n, matches = licenses.LicenseIndex().scan(text)
    base = [m for m in matches if m["base"]]
    starts = [m["start"] for m in base]
    assert (n, len(base), min(starts, default=None), max(starts, default=None), sorted({m["label"] for m in base})) == brute_phrases(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "apache", "general", "public", "x", "é", "under", "the"]), max_size=25))
def test_phrases_equal_brute_force_on_mixtures(words):
    n, matches = licenses.LicenseIndex().scan(" ".join(words))
    base = [m for m in matches if m["base"]]
    assert (n, len(base)) == brute_phrases(" ".join(words))[:2]
    assert all(0 <= m["coverage"] <= 1 for m in matches)


def test_templates_bear_edits_and_need_their_key_phrases():
    scan = lambda t: {m["label"] for m in licenses.LicenseIndex().scan(t)[1] if m["found"]}
    bsd = licenses.TEMPLATES[5][1]
    assert "bsd" in scan("intro words " + bsd) and "bsd" in scan(bsd.replace("with or without modification", "with modification"))
    assert "bsd" not in scan(bsd.replace("source and binary forms", "source forms"))
    assert scan("Licensed under the Apache License, Version 2.0.") == {"apache", "apache-2.0"}
    assert "cc-by-nc" in scan("Licensed under CC BY-NC 4.0.") and not scan("a plain text under the sun, by and for all")


def test_license_scan_keeps_every_row(spark):
    got = licenses.scan_licenses(docs(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "mit license"), (0, None)])).collect()
    assert len(got) == len(ODD) + 2 and licenses.scan_licenses(docs(spark, [])).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (7, None), (8, ""), (2, "ä b"), (None, "a b"), (3, "a b"), (11, "x")] + [(100 + i, "hot text") for i in range(300)]
    df = docs(spark, rows).withColumn("kept", F.lit("clash")).withColumn("extra", F.lit(1)).withColumns({c: F.lit("clash") for c in ("block", "bits", "row", "id", "n", "first", "none")})
    got = exact_dedup.exact_dedup(df)
    assert got.count() == len(rows) and "extra" in got.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for r in got.collect():
        ids = groups[norm(r.text)]
        assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
        assert r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
    assert got.where("kept").count() == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_unique_rows_pass_the_filter(spark):
    one = docs(spark, [(i, f"text {i}") for i in range(500)] + [(1000, "text 1")])
    keys = one.select(F.lit(0).cast("bigint").alias("block"), F.pmod(F.xxhash64("text"), F.lit(32768)).cast("int").alias("b0"), F.pmod(F.xxhash64("text", F.lit(1)), F.lit(32768)).cast("int").alias("b1"))
    assert exact_dedup.repeated_filter(keys, 1).count() == 1
    assert exact_dedup.exact_dedup(one).where("not kept").select("doc_id").collect()[0].doc_id == 1000


# -- 3 ---------------------------------------------------------------------------------------------------------------------------------


def test_generated_pages():
    model, writer = html_extract.fitted(), html_extract._Writer(777)
    right = total = 0
    for _ in range(60):
        page = writer.page()
        order, state = html_extract._labelled(page)
        want = "\n\n".join(x.text[0] for x, k in zip(order, state, strict=True) if not x.children and k == html_extract.IN and x.text and x.text[0])
        right += html_extract.extract([page.replace(" MAIN>", ">")], model)[0] == want
        total += 1
    assert right / total > 0.85


@pytest.mark.parametrize("page", ["", None, "plain", "<", "<p", "</div></p>", "<!--", "<script>x", "<div><p>a<div>b", "<a href='>'>x</a>", "<p>a &amp; &#65; &nope; b", "<table><tr><td>x<tr><td>y", "<li>" * 3000, "\x00<b>퟿"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_extract.extract([page], html_extract.fitted())[0], str)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "</p>" * 100_000, '<a "' * 250_000, '<a ">" ' * 150_000 + '"', "<" * 1_000_000, "<!x" * 300_000, "<div>x" * 160_000, "<a '\"" * 200_000 + ">"])
def test_broken_pages_of_a_megabyte_are_parsed_at_once(page):
    start = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - start < 10  # seconds where time grew with the square of the page: minutes


def test_article_text(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Head &amp; tail</h1><p>One  two\nthree, four five six.<br>More words follow here.<p>Second paragraph has several words too, as texts do.</article><aside class='sidebar'><h3>Popular</h3><a href='/x'>Link</a></aside><section id='comments'><h2>Comments</h2><p>I like this text a lot, thank you.</p></section><footer>&copy; all</footer><script>var a = '<p>';</script></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, None, "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert got[1] == "Head & tail\n\nOne two three, four five six. More words follow here.\n\nSecond paragraph has several words too, as texts do."
    assert got[2] == "" and got[3] == "" and html_extract.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("start", ["<body>", "<body class=a><div>", "<div>", "<a href=x>skip</a>", "words ", "<noscript><img src=p>off<body>"])
def test_a_head_without_an_end_is_left(start):
    def shown(page):
        return [x.text[0] for x in html_extract.nodes_of(html_extract.parse(page)) if x.text and x.text[0]]

    head = "<!doctype html><html><head><meta charset=utf-8>\n<title>name</title><link href=x><noscript><img src=p>off</noscript><script>var a = 1</script>\n"
    rest = "<p>First paragraph.<p>Second one."
    bare = shown(start.replace("<noscript><img src=p>off", "") + rest)
    assert bare[-2:] == ["First paragraph.", "Second one."] and shown(head + start + rest) == bare
    assert shown(head + "<template><body><p>no</template>" + start + rest) == bare


def test_a_choice_never_contradicts_one_above():
    order = html_extract.nodes_of(html_extract.parse("<div><p>a</p><div><p>b</p><p>c</p></div></div>"))
    log = np.log(np.full((len(order), 3), 1 / 3))
    log[:, html_extract.MIX] = -12
    log[1:3] = np.log([0.01, 0.98, 0.01])
    assert html_extract.decode(order, log) == ["a", "b", "c"]


# -- 4 and 7 -----------------------------------------------------------------------------------------------------------------------------

ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
TEXTS = [None, "", "hello world", "a" * 900, " " * 700, "x  \n\n y" * 90, "it's we'll " * 80, "ü ç " * 200, "日本語 " * 100, "1 2  3\t\t4" * 60, "🙂" * 150, "<|endoftext|>", "word " * 300 + "=" * 400 + " end" * 50]


def test_encoding_equals_the_library_and_decodes_back(spark):
    df = docs(spark, list(enumerate(TEXTS)) + [(None, "null id"), (2, "repeated id")])
    for chunk, overlap in ((32_768, 1_024), (100, 24), (64, 63)):
        out = bpe.decode(bpe.encode(df, BPE_RANKS, BPE_PATTERN, chunk=chunk, overlap=overlap), BPE_RANKS, BPE_PATTERN).collect()
        want = sorted([(str(i), LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(TEXTS)] + [("None", LIBRARY.encode_ordinary("null id"), b"null id"), ("2", LIBRARY.encode_ordinary("repeated id"), b"repeated id")])
        assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in out) == want
    assert bpe.encode(docs(spark, []), BPE_RANKS, BPE_PATTERN).count() == 0


def test_token_counts_from_files(spark):
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 50_000, n).tolist() for n in (0, 1, 5, 0, 40, 300, 2, 0)] + [None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>").coalesce(2)
    folder = scratch_path(spark, "tokens")
    names = token_files.write_token_files(df, folder, END_OF_DOCUMENT).collect()
    want = {(r.file, r.ordinal): len(lists[r.doc_id] or []) for r in names}
    for block in (1, 7, 64, 1 << 20):
        got = token_files.token_counts(spark, folder, END_OF_DOCUMENT, block_tokens=block).collect()
        assert {(r.file, r.ordinal): r.n_tokens for r in got} == want and all(r.ended for r in got)


def test_what_is_not_ended_counts_too(spark):
    folder = scratch_path(spark, "open").removeprefix("file://")
    import os

    os.makedirs(folder)
    np.array([1, 2, END_OF_DOCUMENT, 3], "<u2").tofile(f"{folder}/a.bin")
    open(f"{folder}/b.bin", "wb").close()
    got = token_files.token_counts(spark, "file://" + folder, END_OF_DOCUMENT, block_tokens=2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n_tokens, r.ended) for r in got] == [(0, 2, True), (1, 1, False)]
    with pytest.raises(Exception, match="separator"):
        token_files.write_token_files(spark.createDataFrame([(1, [END_OF_DOCUMENT])], "doc_id long, ids array<int>"), "file://" + folder, END_OF_DOCUMENT).collect()


# -- 5 ---------------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes: dict, weights, share, most):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 50 else None, "src%d" % (i % 7) if i % 3 else ("hot" if i % 2 else None)) for i in range(1500)]
    df = docs(spark, rows, "doc_id long, text string, source string").withColumn("taken", F.lit(1))
    got = mixing.mix(df).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    wide = mixing.mix(df, payload=True)
    assert sorted((str(r.doc_id), r.taken) for r in wide.collect()) == sorted((str(r.doc_id), r.taken) for r in got) and "text" in wide.columns


def test_mixing_of_little(spark):
    none = docs(spark, [], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    empty = docs(spark, [(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)] * 2


# -- 8 ---------------------------------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_everything(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9))))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "some text"), (1002, "x" * 200_000)]
    d = docs(spark, rows).withColumns({c: F.lit("clash") for c in ("words", "chars", "x_upper", "score", "label")})
    lab = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(d, lab)
    assert 0 < len(model.rules) <= quality.MAX_RULES
    got = {r.doc_id: r for r in quality.score_quality(d, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, q) for i, q, _ in labels if got[i].held_out]
    assert len(held) > 60 and np.mean([(got[i].score >= 0.3) == bool(q) for i, q in held]) > 0.97
    assert got[1].x_upper == "clash"
    assert quality.fit_quality(d, lab.limit(0)).rules == [] and quality.score_quality(d.limit(0), model).count() == 0
    assert len(quality.fit_quality(d, lab, max_train=50).rules) >= 0
