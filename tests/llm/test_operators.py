"""Operators against brute force, round trips and held-out accuracy, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quietframe.llm import op01_sstable, op02_langid, op03_jaccard, op04_ann, op05_decontaminate, op06_warc, op07_substrings, op08_toxicity, op09_packing, op10_lines
from quietframe.llm.common import scratch_path, tokenizer_path
from quietframe.llm.components import components
from quietframe.llm.kernels import text_buffers
from quietframe.llm.tokens import Encoder

ODD = [None, "", " ", "\n\n", "a", "one two", "É Ü ß 日本語", "x" * 300_000, "word " * 5_000, "\x00 b\tc\r\nd", "it's we'll <|endoftext|> don't  x"]


def texts(seed: int = 1) -> list[tuple[int, str | None]]:
    """Odd texts, copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéü") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(120), say(60)
    out = [*ODD, base, base]
    for _ in range(25):
        w = base.split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    out += [say(r.randint(1, 90)) + " " + passage + " " + say(r.randint(1, 90)) for _ in range(10)]
    out += [say(r.randint(1, 9)) + "\n" + say(12) + "\nTHE same LINE here\n  the same line HERE \n" + say(3) for _ in range(10)]
    return list(enumerate(out))


DOCS = "doc_id long, text string, lang string, bucket int"


def frame(spark, rows):
    """With an extra column whose name operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = Encoder(tokenizer_path(name))
    rows = [t or "" for _, t in texts()]
    for e.KEPT, e.BYTES, e.SLICE in ((10**6, 1 << 24, 1 << 21), (10**6, 1 << 24, 1 << 21), (50, 1 << 12, 1 << 9)):
        got = [ids[at[k] : at[k + 1]].tolist() for _, ids, at in e.rows(*text_buffers(pa.array(rows))) for k in range(len(at) - 1)]
        assert got == [x.ids for x in e.tok.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_white_space_before_letters(name):
    e, r = Encoder(tokenizer_path(name)), random.Random(4)
    parts = ["\n", "\n\n", "\r\n", " ", "\t", "\u3000", "\u00a0", "a", "The", "É", " Été", " word", " ÀB", "e\u0301", "×", "İ", "ﬁ", "日", "7", ".", "'s", "’", "\x00", "<|endoftext|>"]
    rows = ["x\n\na", "x\n \na", "one.\n\nTwo\n\n\nÉ", "\n\na", "\na", *("".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(30_000))]
    got = [ids[at[k] : at[k + 1]].tolist() for _, ids, at in e.rows(*text_buffers(pa.array(rows))) for k in range(len(at) - 1)]
    assert got == [x.ids for x in e.tok.encode_batch(rows, add_special_tokens=False)]


def test_sstable(spark):
    rows = [*texts(), (3, "again"), (-5, "below"), (None, "no key")]
    manifest = op01_sstable.write_tables(frame(spark, rows), scratch_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"), shards=3)
    got = sorted(tuple(r)[:4] for r in op01_sstable.read_tables(manifest).collect())
    tok = Encoder(tokenizer_path("byte_bpe_50k.json")).tok
    want, start = [], 0
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    found = {}
    for m in manifest.collect():
        t = op01_sstable.TableReader(m["path"])
        for i, _ in rows:
            if i is not None and (ids := t.get(i)) is not None:
                found[i] = ids.tolist()
        assert t.get(10**9) is None
    assert set(found) == {i for i, _ in rows if i is not None}
    assert found[12] == [*tok.encode(dict(texts())[12], add_special_tokens=False).ids, 0]
    small = op01_sstable.write_tables(frame(spark, rows), scratch_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"), shards=2, shard_bytes=1)
    assert small.count() >= 2 and sorted(tuple(r)[:4] for r in op01_sstable.read_tables(small).collect()) == got
    assert op01_sstable.read_tables(op01_sstable.write_tables(empty(spark), scratch_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_langid(spark):
    r = random.Random(2)
    words = {"en": "the of and to in that".split(), "de": "der die und über für".split(), "fr": "le la été où dans".split()}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(30)), x) for i in range(300) for x in [r.choice(list(words))]]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 ...", "en"), (1003, "the and of", None), (None, "die und", "de")]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in op02_langid.predict(df, op02_langid.train(df)).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum(got[i]["_lang"] == x for i, _, x in held) > 0.97 * len(held)
    assert [got[i]["_lang"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["_score"] == 0
    assert got[1003]["_lang"] == "en" and len(got) == 306 - 1 and 0 <= got[1003]["_score"] <= 1
    assert op02_langid.train(empty(spark)) is None
    assert [x["_lang"] for x in op02_langid.predict(frame(spark, [(1, "the")]), None).collect()] == ["und"]


def brute_components(rows):
    sets = [next(iter(op03_jaccard.shingle_sets(*text_buffers(pa.array([t], pa.string()))))) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp[find(i)] = min(comp.get(find(i), d), d)
    return sorted((d, len(sets[i]), comp[find(i)]) for i, (d, _) in enumerate(rows))


def crowd(seed: int = 3) -> list[tuple[int, str]]:
    """Near copies of near copies, texts that share most of a passage but too little to be
    linked, and some that share a short one."""
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, long, short = say(80), say(60), say(20)
    out = []
    for _ in range(30):  # a chain: each a word from the last, linked with few others
        base = list(base)
        base[r.randrange(80)] = say(1)[0]
        out.append(" ".join(base))
    out += [" ".join(say(5) + long + say(5)) for _ in range(25)]
    out += [" ".join(say(30) + short + say(30)) for _ in range(25)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("limits", [(2048, 1024, 16, 1024), (8, 6, 4, 16)])
@pytest.mark.parametrize("make", [texts, crowd])
def test_jaccard(spark, monkeypatch, limits, make):
    """With small cells the splits by pivots, windows and counts run as well."""
    for name, value in zip(("CELL", "GROUP", "PIVOTS", "MOST_PIVOTS"), limits, strict=True):
        monkeypatch.setattr(op03_jaccard, name, value)
    rows = make(3)
    got = sorted(tuple(r)[:3] for r in op03_jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len(got) - 8


@pytest.mark.parametrize("replicates", [0.0, 3.0])
def test_jaccard_cells(spark, monkeypatch, replicates):
    """One cell of all: however windows and counts split it, the links give the components."""
    for name, value in (("CELL", 12), ("GROUP", 10), ("PIVOTS", 6), ("MOST_PIVOTS", 24), ("REPLICATES", replicates), ("TOKENS", 5000)):
        monkeypatch.setattr(op03_jaccard, name, value)
    rows = crowd(7)
    sets = [next(iter(op03_jaccard.shingle_sets(*text_buffers(pa.array([t]))))) for _, t in rows]
    table = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for (i, _), s in zip(rows, sets, strict=True)], "rep long, n long, set binary")
    members = spark.createDataFrame([(1, i, i) for i, _ in rows], "cell long, rep long, lab long")
    links = op03_jaccard._union(op03_jaccard.link_cells(members, table))
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert [(i, found.get(i, i)) for i, _ in rows] == [(i, c) for i, _, c in brute_components(rows)]


def test_jaccard_cell_of_thousands_that_are_not_linked(spark):
    r = random.Random(1)
    sets = [np.unique(np.array([*range(5), *(r.getrandbits(62) for _ in range(25))], np.uint64)) for _ in range(5200)]
    sets[7], sets[4000] = sets[4000], np.append(sets[4000][:-1], np.uint64(1 << 63))
    table = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "rep long, n long, set binary")
    members = spark.createDataFrame([(1, i, i) for i in range(5200)], "cell long, rep long, lab long")
    links = op03_jaccard._union(op03_jaccard.link_cells(members, table)).collect()
    assert {tuple(sorted(x)) for x in links} == {(7, 4000)}


def test_jaccard_odd(spark):
    got = op03_jaccard.jaccard_components(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    # Texts that share a doc_id are judged apart, and none loses its links.
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = op03_jaccard.jaccard_components(frame(spark, [(5, a), (5, b), (5, None), (7, b + " x"), (3, a + " y"), (9, a)])).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(3, 27, 3), (5, 0, 5), (5, 26, 3), (5, 26, 5), (7, 27, 5), (9, 26, 3)]
    assert op03_jaccard.jaccard_components(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_ann(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(1500, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, [1.0]), (None, [1.0] * 16)]
    got = op04_ann.nearest(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")).collect()
    by = {}
    for x in got:
        by.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(by) == set(range(0, 1500, 20))
    d, hit = v.astype(np.float64), 0
    for q, near in by.items():
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        hit += len(set(want.tolist()) & {x[1] for x in near})
        assert [x[0] for x in sorted(near)] == list(range(1, 21))
        assert all(abs(x[2] - s[x[1]]) < 1e-9 for x in near)
    assert hit >= 0.95 * 20 * len(by)
    assert [x[1] for x in sorted(by[120])] == [i for i in range(100, 140) if i != 120][:20]
    assert op04_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def ann_state(spark, v: np.ndarray, near: dict[int, list[int]], asked: list[int], per: int):
    """Parts of `per` nodes of vectors `v`, node i having vec_id 10 * i and the neighbours near[i]."""
    k, n, rows = op04_ann.NEIGHBOURS, len(v), []
    gid = lambda i: (i // per) << op04_ann.SHIFT | i % per
    for p in range(-(-n // per)):
        own = range(p * per, min(n, (p + 1) * per))
        ids, sims = np.full((len(own), k), -1, np.int64), np.full((len(own), k), -np.inf, np.float32)
        for r, i in enumerate(own):
            order = sorted(near[i], key=lambda j: -float(v[i] @ v[j]))
            ids[r, : len(order)], sims[r, : len(order)] = [gid(j) for j in order], v[order] @ v[i]
        rows.append((p, *(bytearray(x.tobytes()) for x in (np.array([10 * i for i in own], np.int64), v[own.start : own.stop], np.array([i in asked for i in own], np.uint8), ids, sims, (ids >= 0).astype(np.uint8))), 0))
    return spark.createDataFrame(rows, op04_ann._STATE)


def ann_lists(df, width: int, n: int, per: int):
    """Neighbours of each node (or search) as plain numbers."""
    out = {}
    for r in df.collect():
        ids = np.frombuffer(r["ids"], np.int64).reshape(-1, width)
        for k, x in enumerate(ids):
            out[r["part"], k] = [int(g >> op04_ann.SHIFT) * per + int(g & op04_ann._LOCAL) for g in x if g >= 0]
    return out


def test_ann_search_goes_on_until_nearest_are_expanded(spark):
    """Along an arc whose nodes only know the next ones, from a node that knows one far off."""
    n = 60
    v = np.stack([np.cos(np.arange(n) / 40), np.sin(np.arange(n) / 40)], 1).astype(np.float32)
    near = {0: [n - 1]} | {i: [j for j in (i - 1, i + 1) if 0 < j < n] for i in range(1, n)}
    state = ann_state(spark, v, near, [0], 7)
    found = op04_ann.search(state, 2, beam=8)
    assert ann_lists(found, 8, n, 7) == {(0, 0): list(range(1, 9))}
    assert op04_ann.recall(found, state, 2, 8, top=8) == 1.0
    assert sorted(tuple(r) for r in op04_ann.answers(found, state, 8, 3).collect()) == [(0, 10), (0, 20), (0, 30)]


def test_ann_recall_is_that_of_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8)).astype(np.float32)
    near = {i: r.choice([j for j in range(300) if j != i], 40, replace=False).tolist() for i in range(300)}
    asked = list(range(0, 300, 3))
    state = ann_state(spark, v, near, asked, 64)
    found = op04_ann.begin(state, 8, 40)
    want = []
    for i in asked:
        s = v @ v[i]
        s[i] = -np.inf
        have = sorted(near[i], key=lambda j: -s[j])[:20]
        want.append(len(set(have) & set(np.argsort(-s)[:20].tolist())) / 20)
    assert abs(op04_ann.recall(found, state, 8, 40) - np.mean(want)) < 1e-9


def test_ann_round_only_gets_nearer(spark):
    """Lists stay sorted and distinct, hold what was nearest, and `changed` counts what is new."""
    r = np.random.default_rng(6)
    v = r.normal(size=(200, 8)).astype(np.float32)
    near = {i: r.choice([j for j in range(200) if j != i], 48, replace=False).tolist() for i in range(200)}
    state = ann_state(spark, v, near, [], 64)
    before = ann_lists(state, 48, 200, 64)
    after = op04_ann.descend(state, 8, 1)
    got, new = ann_lists(after, 48, 200, 64), 0
    for (p, k), x in got.items():
        i = p * 64 + k
        s = v @ v[i]
        assert i not in x and len(set(x)) == len(x) == 48
        assert all(a >= b - 1e-5 for a, b in zip(s[x], s[x][1:]))
        assert set(x) >= {j for j in before[p, k] if s[j] > s[x[-1]] + 1e-5}
        new += len(set(x) - set(before[p, k]))
    assert after.agg({"changed": "sum"}).first()[0] == new > 0
    assert op04_ann.changed(after, 200) == new / (200 * 48)


def test_ann_descends_until_settled(spark, monkeypatch):
    rounds, shares = [], iter([0.5] * 7 + [op04_ann.SETTLED])
    monkeypatch.setattr(op04_ann, "first_graph", lambda *a: None)
    monkeypatch.setattr(op04_ann, "descend", lambda graph, *a: rounds.append(1))
    monkeypatch.setattr(op04_ann, "changed", lambda *a: next(shares))
    monkeypatch.setattr(op04_ann, "drop_table", lambda *a: None)
    op04_ann.neighbour_graph(None, 2, 10)
    assert len(rounds) == 8


def test_ann_searches_again_until_recall_is_reached(spark, monkeypatch):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(1500)], "vec_id long, embedding array<float>")
    beams, measured, search = [], iter([0.5, 0.9, 0.96]), op04_ann.search
    monkeypatch.setattr(op04_ann, "search", lambda state, dim, beam: beams.append(beam) or search(state, dim, beam))
    monkeypatch.setattr(op04_ann, "recall", lambda *a: next(measured))
    assert op04_ann.nearest(df).count() == 75 * 20
    assert beams == [128, 256, 512]


def test_ann_widens_the_beam_on_the_sample(spark, monkeypatch):
    """Not all queries search again for each beam, but all have their answers."""
    r = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(300)], "vec_id long, embedding array<double>")
    asked, measured, search = [], iter([0.5, 0.96]), op04_ann.search

    def spy(state, dim, beam):
        asked.append(sum(sum(x["asked"]) for x in state.select("asked").collect()))
        return search(state, dim, beam)

    monkeypatch.setattr(op04_ann, "SAMPLE", 4)
    monkeypatch.setattr(op04_ann, "search", spy)
    monkeypatch.setattr(op04_ann, "recall", lambda *a: next(measured))
    got = op04_ann.nearest(df).collect()
    assert asked == [15, 4]
    assert {x["query_id"] for x in got} == set(range(0, 300, 20)) and len(got) == 15 * 20


def test_ann_sorts_by_one_key():
    r = np.random.default_rng(10)
    u, v, s = r.integers(0, 9, 3000), r.integers(1 << 40, (1 << 40) + 500, 3000), np.round(r.normal(size=3000), 1).astype(np.float32)
    o = np.lexsort((v, -s, u))
    first = [o[u[o] == x][:7] for x in range(9)]
    assert op04_ann._nearest(u, v, s, 7)[0].tolist() == np.concatenate(first).tolist()
    new = op04_ann._unseen(u[:900], v[:900], u[900:], v[900:])
    assert list(zip(new[1].tolist(), new[0].tolist())) == sorted(set(zip(v[:900].tolist(), u[:900].tolist())) - set(zip(v[900:].tolist(), u[900:].tolist())))
    m = r.normal(size=(5, 400)).astype(np.float32)
    assert op04_ann._top(m, 20)[0].tolist() == np.argsort(-m, axis=1)[:, :20].tolist()
    x = np.array([-3e38, -1, -1e-30, -0.0, 1e-30, 2], np.float32)
    keys = op04_ann._encoded(x).reshape(6, 4)
    assert [bytes(k) for k in keys] == sorted(bytes(k) for k in keys) and (op04_ann._decoded(keys.ravel(), "f4") == x).all()


def test_decontaminate(spark, monkeypatch):
    rows = texts(5)
    passage = " ".join(dict(rows)[45].split()[:30])
    bench = [(1, passage), (10, "one two"), (2, None), (3, ""), (None, "a"), (1, passage), (4, dict(rows)[12][:200].upper())]
    docs, b = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(op05_decontaminate.brute_force(rows, [x for x in bench if x[0] is not None]))
    for size in (10**6, 20):
        got = [(r["doc_id"], r["_n_words"], r["_n_hit"], len(r["_items"]), hashlib.sha256(",".join(sorted(map(str, r["_items"]))).encode()).hexdigest(), r["_n_hit"] > 0 and 20 * r["_n_hit"] >= r["_n_words"]) for r in op05_decontaminate.scan(docs, b, block_words=size).collect()]
        assert sorted(got) == want
    monkeypatch.setattr(op05_decontaminate, "GROUP", 500)
    again = op05_decontaminate.scan(docs, b, block_words=20).collect()
    assert sorted((r["doc_id"], r["_n_words"], r["_n_hit"]) for r in again) == [w[:3] for w in want]
    left = {r["doc_id"] for r in op05_decontaminate.remove(docs, b).collect()}
    assert left == {w[0] for w in want if not w[5]}
    assert op05_decontaminate.scan(docs, b.limit(0)).where("_n_hit > 0").count() == 0
    assert op05_decontaminate.scan(empty(spark), b).count() == 0


def test_warc(spark):
    trap = "WARC/1.1\r\nContent-Length: 5\r\nWARC-Type: response\r\nWARC-Page-ID: 99\r\n\r\nabcde\r\n\r\n"
    pages = [(0, "u", "b" + trap), (1, "u\r\nX: y", trap * 3), (2, None, None), (3, "w", ""), (4, "u", trap * 3), (5, "v", "é" * 20_000), (None, "n", "b" + trap), (6, "v", "WARC/1.1\r\n"), (6, "v", "WARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = min((p for p, _, x in pages if (x or "") == (h or "") and p is not None), default=None)
        again = i is not None and first < i
        want.append((-1 if i is None else i, len(raw), op06_warc.base32_sha1(raw), "revisit" if again else "response", first if again else -1))
    for size in (64, 1 << 20):
        m = op06_warc.write_archives(df, scratch_path(spark, "warc"))
        back = op06_warc.read_archives(m, size).collect()
        assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in back) == sorted(want)
        assert {r["page_id"]: r["html"] for r in back}[5] == "é" * 20_000
    long = spark.createDataFrame([(1, "http://x/" + "u" * (5 << 20), trap), (2, "v", "y")], "page_id long, url string, html string")
    back = op06_warc.read_archives(op06_warc.write_archives(long, scratch_path(spark, "warc")), 1 << 16).collect()
    assert sorted((r["page_id"], len(r["url"]), r["html"]) for r in back) == [(1, 9 + (5 << 20), trap), (2, 1, "y")]
    assert op06_warc.read_archives(op06_warc.write_archives(df.limit(0), scratch_path(spark, "warc"))).count() == 0


def test_substrings(spark):
    rows = texts(6)
    for chunk in (op07_substrings.CHUNK, 3000):
        op07_substrings.chunks_of.__defaults__ = (chunk,)
        got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in op07_substrings.removed(frame(spark, rows)).collect()]
        assert sorted(got) == sorted(op07_substrings.brute_force(rows))
    op07_substrings.chunks_of.__defaults__ = (op07_substrings.CHUNK,)
    twice = op07_substrings.removed(frame(spark, [(None, "ab" * 80), (1, "ab" * 80), (1, "ab" * 80)])).collect()
    assert sorted(len(r["kept"]) for r in twice) == [0, 0, 2]
    assert op07_substrings.removed(empty(spark)).count() == 0


def test_toxicity(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        w, bad = [r.choice(vocab) for _ in range(40)], i % 3 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["zzyx", "qqvv"]) + r.choice(["", "s", "en"])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 0, int(bad)))
    df = spark.createDataFrame([*rows, (9000, None, None), (9001, "", "en")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([*labels, (9000, 0, 1), (None, 0, 1), (9001, 0, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["_toxicity"] for x in op08_toxicity.score(df, op08_toxicity.train(df, lab)).collect()}
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in held) >= 0.95 * len(held)
    assert 0 <= got[9000] == got[9001] < 0.5
    assert op08_toxicity.train(df, lab.limit(0)) is None
    assert [x["_toxicity"] for x in op08_toxicity.score(df.limit(1), None).collect()] == [0.0]


def test_packing(spark):
    rows = [*texts(9), (None, "no key"), (3, "again")]
    got = op09_packing.pack(frame(spark, rows), tokenizer_path("word_bpe_49k.json"), length=64).collect()
    tok = Encoder(tokenizer_path("word_bpe_49k.json")).tok
    seqs, docs = {}, {}
    for p in got:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault(p["doc_id"], []).append(p)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 64
    total = sum(p["length"] for p in got)
    assert len(seqs) <= total / 64 + 2 * 4
    for i, t in texts(9):
        if i == 3:
            continue
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(docs[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert None in docs and op09_packing.pack(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 64), lambda r: r.choice([1, 1, 2, 60, 63]), lambda r: r.choice([1, 33, 40, 200])])
def test_packing_takes_the_cheapest_with_room(draw):
    """Against a search of all open sequences; in the second case hundreds of cheap ones are too full."""
    r, n = random.Random(6), 64
    packer, free, new = op09_packing.Packer(0, n), {}, 0  # free: sequence -> (cost, room)
    for _ in range(3):
        sizes, want = [draw(r) for _ in range(700)], []
        for d, x in enumerate(sizes):
            want += [(d, k * n, n, new + k, 0) for k in range(x // n)]
            new += x // n
        rest = sorted(((x % n, d, x - x % n) for d, x in enumerate(sizes) if x % n), key=lambda x: (-x[0], x[1]))
        for _ in range(max(0, -(-(sum(x[0] for x in rest) - sum(f[1] for f in free.values())) // n))):
            free[new], new = (0.0, n), new + 1

        def put(d, start, size, s):
            want.append((d, start, size, s, n - free[s][1]))
            free[s] = (free[s][0] + op09_packing.cost(size), free[s][1] - size)
            if not free[s][1]:
                del free[s]

        late = []
        for size, d, start in rest:
            fits = [(c, s) for s, (c, room) in free.items() if room >= size]
            put(d, start, size, min(fits)[1]) if fits else late.append((size, d, start))
        for size, d, start in late:
            while size:
                _, _, s = min((-room, c, s) for s, (c, room) in free.items())
                k = min(size, free[s][1])
                put(d, start, k, s)
                size, start = size - k, start + k
        assert packer.pack(sizes) == want


def brute_lines(rows):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    first: dict[str, int] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(spark):
    rows = [*texts(10), (70, "the same line here\n" * 200), (71, "É" * 9 + "\n" + "É" * 10), (72, "é" * 10 + "\n" + "É" * 10 + "\n"), (73, "\x1cthe same line here")]
    df = frame(spark, rows)
    done = op10_lines.apply_bitmaps(df, op10_lines.keep_bitmaps(df))
    got = [(r["doc_id"], r["_n_lines"], r["_n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in done.collect()]
    assert sorted(got) == sorted(brute_lines(rows))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    odd = frame(spark, [(None, "the same line here"), (1, "the same line here"), (2, "the same line here"), (2, "the same line here"), (2, "the same line here\nnew")])
    kept = op10_lines.apply_bitmaps(odd, op10_lines.keep_bitmaps(odd)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "the same line here"), (1, "the same line here"), (2, ""), (2, ""), (2, "new")]
    assert op10_lines.apply_bitmaps(empty(spark), op10_lines.keep_bitmaps(empty(spark))).count() == 0


def test_frequencies_count_all_documents(spark):
    rows = [*texts(11), (500, None), (501, "123")]
    df, n = op02_langid.frequencies(frame(spark, rows).select("text").repartition(3))
    want, m = np.zeros(1 << op02_langid.BITS), 0
    for _, t in rows:
        if t and any(c.isalpha() for c in t):
            m += 1
            want[np.unique(np.concatenate([g for g, _ in op02_langid.grams(*text_buffers(pa.array([t])))]))] += 1
    assert n == m and (df == want).all()


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "en" if i % 4 else "de") for i in range(400)], "doc_id long, text string, lang string")
    pairs = docs.select("doc_id", "lang")
    count = lambda *a: sorted((r["lang"], r["count"]) for r in op02_langid.sample(docs, pairs, "lang", *a).groupBy("lang").count().collect())
    assert count(40, 1 << 20) == [("de", 20), ("en", 20)]
    assert count(10**6, 6000) == [("de", 30), ("en", 30)]


def test_thresholds_follow_all_labels(spark):
    """The sample is balanced; rows beyond it move the cut to where F1 is best among all."""
    m = op08_toxicity.Model(np.zeros((1, 1)), [], [], np.zeros(1), 0.0, langs=["a", "b"], fitted=[0])
    rows = [(i, float(z), g, True) for i, (z, g) in enumerate([(9.0, 0), *[(2.0, 0)] * 30, *[(1.0, 0)] * 400, *[(-1.0, 1)] * 25, *[(-3.0, 1)] * 25])]
    rows.append((10_000, 50.0, 0, False))
    toxic = {i: int(z == 2.0 or (g == 1 and z == -1.0) or i < 90 and z == 1.0) for i, z, g, _ in rows}
    keep = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    seen = spark.createDataFrame(rows, "doc_id long, _logit double, _guess int, _some boolean")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    few, op08_toxicity.FEW = op08_toxicity.FEW, 5
    try:
        got = op08_toxicity.calibrate(seen, labels, m).thresholds
    finally:
        op08_toxicity.FEW = few
    for g in (0, 1):
        mine = [(z, toxic[i]) for i, z, lang, some in rows if lang == g and some and i not in m.fitted and keep(i)]
        f1 = lambda cut: 2 * sum(y for z, y in mine if z > cut) / max(1, sum(z > cut for z, _ in mine) + sum(y for _, y in mine))
        assert f1(got[g]) == max(f1(cut) for cut in (-9, -2, 0, 1.5, 3))


CLASH = ("_lang", "_score", "_words", "_n_lines", "_n_dropped", "_n_words", "_n_hit", "_items", "_spans", "_toxicity", "_logit", "_guess", "_nth", "_gone", "_bitmap_of", "_bitmap_words", "_h1", "salt", "key", "line", "pos")


def test_columns_that_clash(spark):
    """Extra columns of any name come back unchanged."""
    rows = [(i, t, "en", i) for i, t in texts(12)[10:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, own int").select("*", *[__import__("pyspark").sql.functions.lit(f"mine {c}").alias(c) for c in CLASH])
    bench = spark.createDataFrame([(1, rows[2][1][:150])], "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i, *_ in rows], "doc_id long, toxic int")
    for out in (
        op02_langid.predict(df, op02_langid.train(df)),
        op05_decontaminate.scan(df, bench),
        op05_decontaminate.remove(df, bench),
        op08_toxicity.score(df, op08_toxicity.train(df, labels)),
        op10_lines.apply_bitmaps(df, op10_lines.keep_bitmaps(df)),
    ):
        assert out.columns[: len(df.columns)] == df.columns and len(set(out.columns)) == len(out.columns)
        for r in out.collect():
            assert all(r[c] == f"mine {c}" for c in CLASH)
    assert op03_jaccard.jaccard_components(df).count() == len(rows)
    assert op09_packing.pack(df, tokenizer_path("word_bpe_49k.json")).count() >= len(rows)
    assert op07_substrings.removed(df).count() == len(rows)


def test_very_long_texts(spark):
    """Texts above the sizes of slices, chunks and groups, against brute force."""
    r = random.Random(13)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    long = " ".join(r.choice(vocab) for _ in range(900_000))  # some 5.8 MB
    rows = [(1, long), (2, long[:2_000_000] + "\n" + long[3_000_000:]), (3, " ".join(r.choice(vocab) for _ in range(50))), (4, long[:-9])]
    df = frame(spark, rows)
    assert sorted(tuple(x)[:3] for x in op03_jaccard.jaccard_components(df).collect()) == brute_components(rows)
    bench = [(7, long[1_900_000:2_100_000]), (8, long[-100:])]
    got = op05_decontaminate.scan(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    hits = {x["doc_id"]: (x["_n_hit"], list(x["_items"])) for x in got}
    assert hits[1][1] == [7, 8] and hits[2][1] == [7, 8] and hits[3] == (0, []) and hits[4][1][0] == 7
    tok = Encoder(tokenizer_path("byte_bpe_50k.json")).tok
    back = {x["doc_id"]: x for x in op01_sstable.read_tables(op01_sstable.write_tables(df, scratch_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"), shards=2)).collect()}
    for i, t in rows[1:3]:
        assert back[i]["ids_crc32"] == zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    done = op10_lines.apply_bitmaps(df, op10_lines.keep_bitmaps(df)).collect()
    assert sorted((x["doc_id"], x["_n_lines"], x["_n_dropped"]) for x in done) == [(1, 1, 0), (2, 2, 0), (3, 1, 0), (4, 1, 0)]
    assert len(op02_langid.predict(df, op02_langid.train(df)).collect()) == 4
