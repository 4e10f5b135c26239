"""Stages of the corpus pipeline on their own inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quietframe.llm import op02_langid, op05_decontaminate
from quietframe.llm.common import tokenizer_path
from quietframe.llm.kernels import LOWER
from quietframe.llm.tokens import Encoder

from .test_operators import brute_components, brute_lines
from .test_queries import table

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("text", __import__("pyspark").sql.functions.expr("CASE WHEN doc_id = 7 THEN NULL ELSE text END"))
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test")
        assert out.columns == columns, name
        assert 0.8 * n <= out.count() <= n
        docs, n = out, out.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_near_duplicates_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "z"), (3, None)], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == [-1, 1, 3]


@pytest.fixture(scope="module")
def docs(spark):
    """Whole documents with nulls, empty texts, repeated rows and a clashing column."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = d.where("doc_id < 4").withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.expr("element_at(array(null, '', '1 2 3', 'a b'), cast(doc_id - 99999 as int))"))
    return d.union(odd).union(d.where("doc_id in (20, 21)")).withColumn("_n_lines", F.lit(-1)).cache()


def plain(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0], r[1] or ""))


def test_language_id_keeps_the_likely(spark, docs):
    p = op02_langid.predict(docs, op02_langid.train(docs)).collect()
    want = sorted((r["doc_id"], r["text"]) for r in p if r["_lang"] != "und" and r["_score"] >= corpus_pipeline.LEAST_SCORE)
    assert plain(corpus_pipeline.language_id(spark, docs, SMALL)) == want
    assert len(want) >= 0.9 * len(p)


def test_line_dedup_is_that_of_brute_force(spark, docs):
    rows = plain(docs)
    want = {(i, h): n - lost for i, n, lost, h in brute_lines(rows)}
    out = corpus_pipeline.line_dedup(spark, docs, SMALL).collect()
    got = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out}
    assert got == set(want) and len(out) == len(rows)
    assert all(r["_n_lines"] == -1 and (r["text"] is None or r["n_chars"] == len(r["text"])) for r in out)


def test_near_duplicates_keeps_the_least_of_each_component(spark, docs):
    rows = plain(docs)
    distinct = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    first = {c for _, _, c in brute_components(distinct)}
    want = sorted(((i, t) for i, t in distinct if i in first), key=lambda r: (r[0], r[1] or ""))
    got = plain(corpus_pipeline.near_duplicates(spark, docs, SMALL))
    assert got == want and len(got) < len(distinct)


def test_near_duplicates_judges_texts_of_one_id_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (5, b), (7, b + " x"), (3, a + " y"), (5, "c d"), (5, None), (5, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert plain(got) == [(3, a + " y"), (5, None), (5, None), (5, b), (5, "c d")]


def test_decontaminate_cuts_what_brute_force_hits(spark, docs):
    bench, rows = table("benchmark", "item_id", "text"), plain(docs)
    pat, n = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), op05_decontaminate.N
    windows = set()
    for _, t in bench:
        w = [m.group() for m in pat.finditer(bytes(LOWER[np.frombuffer((t or "").encode(), np.uint8)]))]
        windows |= {tuple(w[k : k + min(n, len(w))]) for k in range(len(w) - min(n, len(w)) + 1)} if w else set()
    sizes, want = {len(x) for x in windows}, []
    for i, t in rows:
        raw = (t or "").encode()
        at = list(pat.finditer(bytes(LOWER[np.frombuffer(raw, np.uint8)])))
        hit = {j for m in sizes for k in range(len(at) - m + 1) if tuple(x.group() for x in at[k : k + m]) in windows for j in range(k, k + m)}
        if hit and 20 * len(hit) >= len(at):
            continue
        out, last = b"", 0
        for j in sorted(hit):
            out += raw[last : at[j].start()] if j - 1 not in hit else b""
            last = at[j].end()
        want.append((i, (out + raw[last:]).decode() if t is not None else None))
    got = plain(corpus_pipeline.decontaminate(spark, docs, SMALL))
    assert got == sorted(want, key=lambda r: (r[0], r[1] or "")) and len(got) < len(rows)


def test_packing_keeps_every_id(spark, docs):
    tok, got = Encoder(tokenizer_path("word_bpe_49k.json")).tok, {}
    for p in corpus_pipeline.packing(spark, docs, SMALL).collect():
        got.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"]))
    once = {i: t for i, t in plain(docs) if i not in (20, 21)}
    for i, t in once.items():
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for start, n, crc in sorted(got[i]):
            assert (start, crc) == (at, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
            at += n
        assert at == len(ids)
