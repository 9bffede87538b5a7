from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op5_mixing"])
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    rows = lambda df: sorted(tuple(str(round(v, 5)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_licences_equal_brute_force(spark, texts):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r.doc_id: r for r in entry.queries()["op1_licenses"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        r, labels = got[i], sorted({x for _, x in at})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(labels))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score >= 0.75) == bool(r.labels)


def test_tokens_equal_the_library(spark, texts):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in entry.queries()["op7_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], disallowed_special=())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(texts[r.doc_id].encode()))


def test_vectors_equal_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r.label for r in rows]), [r.vec_id for r in rows]
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in entry.queries()["op9_embed_dedup"](spark, SF).collect()}
    assert sum(got.values()) >= 0.9 * near.sum() and all(got[i] <= n for i, n in zip(ids, near.sum(1), strict=True))


def test_near_copies_under_one_id_are_told_apart(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:59], "other"]
    rows = [(3, " ".join(base)), (5, " ".join(near)), (5, " ".join(f"x{i}" for i in range(40))), (None, " ".join([*base[:58], "one", "two"])), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert left == {rows[0], rows[2], rows[4]}
