"""The registered queries on a small fixture, whole tables, against brute force."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from quietframe.llm import op05_decontaminate, op06_warc, op07_substrings, op10_lines
from quietframe.llm.common import tokenizer_path
from quietframe.llm.tokens import Encoder

from .test_operators import brute_components, brute_lines

SMALL = "/root/testdata/sf0.001"


def table(name, *cols, sf=SMALL):
    return [tuple(r.values()) for r in pq.read_table(f"{sf}/{name}.parquet", columns=list(cols)).to_pylist()]


@pytest.fixture(scope="module")
def run(spark):
    q = __spark_entry__.queries()
    return lambda name, sf=SMALL: q[name](spark, sf)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_op1(run):
    tok, start, want = Encoder(tokenizer_path("byte_bpe_50k.json")).tok, 0, []
    for i, t in sorted(table("documents", "doc_id", "text")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(run("op1_sstable"), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op2(run):
    lang = dict(table("documents", "doc_id", "lang", sf="/root/testdata/sf0.01"))
    got = [r for r in run("op2_langid", "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.97 * len(got)


def test_op3(run):
    assert rows(run("op3_jaccard"), "doc_id", "n_shingles", "component_id") == brute_components(table("documents", "doc_id", "text"))


def test_op4(run):
    ids, v = zip(*table("embeddings", "vec_id", "embedding"), strict=True)
    m, ids, hit = np.array(v, np.float32).astype(float), np.array(ids), 0
    got = run("op4_ann").collect()
    for q in ids[ids % 20 == 0]:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 0.9 * len(got) and len(got) == 20 * (ids % 20 == 0).sum()


def test_op5(run):
    want = op05_decontaminate.brute_force(table("documents", "doc_id", "text"), table("benchmark", "item_id", "text"))
    assert rows(run("op5_decontaminate"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


def test_op6(run):
    pages, first = sorted(table("pages", "page_id", "html")), {}
    want = []
    for i, h in pages:
        raw = (h or "").encode()
        f = first.setdefault(raw, i)
        want.append((i, len(raw), op06_warc.base32_sha1(raw), "response" if f == i else "revisit"))
    assert rows(run("op6_warc"), "page_id", "payload_bytes", "payload_digest", "record_type") == want


def test_op7(run):
    assert rows(run("op7_substrings"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(op07_substrings.brute_force(table("documents", "doc_id", "text")))


def test_op8(run):
    toxic = dict(table("labels", "doc_id", "toxic", sf="/root/testdata/sf0.1"))
    got = [r for r in run("op8_toxicity", "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in toxic]
    bad = [r for r in got if toxic[r["doc_id"]]]
    assert sum(r["predicted"] for r in bad) >= 0.8 * len(bad)
    assert sum(r["predicted"] for r in got) - sum(r["predicted"] for r in bad) <= 0.02 * len(got)


def test_op9(run):
    tok, got, seqs = Encoder(tokenizer_path("word_bpe_49k.json")).tok, {}, {}
    for p in run("op9_packing").collect():
        got.setdefault(p["doc_id"], []).append(p)
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, t in table("documents", "doc_id", "text"):
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(got[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes()))
            at += p["length"]
        assert at == len(ids)
    total = sum(n for s in seqs.values() for _, n in s)
    assert all(sum(n for _, n in s) <= 2048 and [o for o, _ in sorted(s)] == np.cumsum([0, *(n for _, n in sorted(s))])[:-1].tolist() for s in seqs.values())
    assert 2048 * len(seqs) <= 1.01 * total + 2 * 2048


def test_op10(run):
    docs = table("documents", "doc_id", "text")
    got = rows(run("op10_line_dedup"), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(brute_lines(docs))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert got == sorted(c.execute(op10_lines.SQL).fetchall())
