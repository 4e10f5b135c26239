"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is N
consecutive words of an item; an item of fewer words, but not none, is one window.
Training texts are scanned window by window against sorted 64-bit hashes; a hit
counts once its words equal those of the item's window.

The hash set is broadcast while the benchmark has no more than BLOCK_WORDS words
(about 100 bytes each).  A larger one is cut into such blocks, built one at a time,
kept as files in the shared folder and held in turn against every GROUP of text.

Contract for odd rows: null or empty text has no words and is clean; items with
null text, or null item_id, take no part; items that are repeated count once;
rows of documents come out as often as they stand, extra columns unchanged; with
no items nothing is hit."""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, open_fs, pick, read_table, scratch_path, write_file
from .kernels import ALNUM_WORD, LOWER, gram_hashes, prefix_sums, row_slices, span_hashes, text_buffers, trim, words

N = 13
#: Words of the benchmark that are in memory at a time.
BLOCK_WORDS = 2_000_000
#: Bytes of text that wait while a block of several is read.
GROUP = 16 << 20
SCHEMA = T.StructType([
    T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()), T.StructField("_items", T.ArrayType(T.LongType())),
    T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


class Block:
    """Windows of some items: by length, sorted hashes; by hash, (words, items)."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        by_len: dict[int, list] = defaultdict(list)
        self.windows: dict[int, list[tuple[bytes, list[int]]]] = defaultdict(list)
        found: dict[tuple[int, bytes], list[int]] = {}
        for item, text in items:
            data, off = text_buffers(pa.array([text]))
            low = LOWER[data]
            ws, we, _ = words(low, off, ALNUM_WORD)
            if not len(ws):
                continue
            h, raw = span_hashes(prefix_sums(low), ws, we), low.tobytes()
            m = min(n, len(ws))
            for k, g in enumerate(gram_hashes(h, m).tolist()):
                key = b" ".join(raw[ws[i] : we[i]] for i in range(k, k + m))
                if (g, key) not in found:
                    found[g, key] = []
                    self.windows[g].append((key, found[g, key]))
                    by_len[m].append(g)
                if item not in found[g, key]:
                    found[g, key].append(item)
        self.hashes = {m: np.unique(np.array(x, np.uint64)) for m, x in by_len.items()}

    def scan(self, raw: bytes, ws: np.ndarray, we: np.ndarray, row: np.ndarray, h: np.ndarray, hit: np.ndarray, items: dict[int, set]) -> None:
        """Marks hit words and collects the items of each row."""
        for m, known in self.hashes.items():
            g = gram_hashes(h, m)
            if not len(g):
                continue
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            for k in np.flatnonzero((known[at] == g) & (row[: len(g)] == row[m - 1 :])).tolist():
                key = b" ".join(raw[ws[i] : we[i]] for i in range(k, k + m))
                for words_, those in self.windows[int(g[k])]:
                    if words_ == key:
                        hit[k : k + m] = True
                        items[int(row[k])].update(those)


def blocks_of(bench: DataFrame, n: int, most: int) -> Iterator[Block]:
    """The benchmark, streamed to the driver in blocks of at most `most` words."""
    held, size, some = [], 0, False
    rows = pick(bench, "item_id", "text").where("item_id is not null and text is not null").distinct()
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 2 + 1
        if size >= most:
            yield Block(held, n)
            held, size, some = [], 0, True
    if held or not some:
        yield Block(held, n)


def names(columns: list[str]) -> list[str]:
    """What the columns of SCHEMA are called beside `columns`."""
    return [fresh(columns, c) for c in SCHEMA.names]


def scan(docs: DataFrame, bench: DataFrame, n: int = N, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """`docs` with _n_words, _n_hit, _items (ids of items with occurring windows) and
    _spans (byte ranges of the UTF-8 text that hit words cover, a run of hit words
    being one); underscores come before these where `docs` has such names.  With `cut`
    the spans are cut from the texts of rows that aren't contaminated."""
    spark = docs.sparkSession
    blocks = blocks_of(bench, n, block_words)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        sent, most = spark.sparkContext.broadcast(block), 1 << 21
        load = lambda: [sent.value]
    else:
        top, most = scratch_path(spark, "benchmark"), GROUP
        paths: list[str] = []
        while block is not None:
            paths.append(f"{top}/{len(paths)}.block")
            write_file(paths[-1], [pickle.dumps(block)])
            block, after = after, next(blocks, None)

        def load():
            for p in paths:
                f, inner = open_fs(p)
                with f.open_input_stream(inner) as s:
                    yield pickle.loads(s.read())

    def prepared(data: np.ndarray, off: np.ndarray, i: int, j: int):
        low, at = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        ws, we, row = words(low, at, ALNUM_WORD)
        return at, low.tobytes(), ws, we, row, span_hashes(prefix_sums(low), ws, we), np.zeros(len(ws), bool), defaultdict(set)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            out: list[tuple[list, list, list, list]] = []
            for x, y in row_slices(off, most):
                slices = [prepared(data, off, x + i, x + j) for i, j in row_slices(off[x : y + 1] - off[x])]
                for block in load():
                    for _, raw, ws, we, row, h, hit, items in slices:
                        block.scan(raw, ws, we, row, h, hit, items)
                out += [_found(*s) for s in slices]
            cols = [[v for part in out for v in part[k]] for k in range(4)]
            own = list(batch.columns)
            if cut:
                at = batch.schema.names.index("text")
                texts = batch.column(at).to_pylist()
                for k, spans in enumerate(cols[3]):
                    if spans and 20 * cols[1][k] < cols[0][k]:
                        texts[k] = _without(texts[k].encode(), spans).decode()
                own[at] = pa.array(texts, batch.schema.types[at])
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*batch.schema.names, *new])
        trim()

    new = names(docs.columns)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, f.dataType) for c, f in zip(new, SCHEMA.fields, strict=True))]))


def _found(at: np.ndarray, raw: bytes, ws: np.ndarray, we: np.ndarray, row: np.ndarray, h: np.ndarray, hit: np.ndarray, items: dict[int, set]) -> tuple[list, list, list, list]:
    """Words, hit words, items and spans of the rows of a slice."""
    n = len(at) - 1
    spans: dict[int, list] = defaultdict(list)
    for k in np.flatnonzero(hit).tolist():
        r = int(row[k])
        if k and hit[k - 1] and row[k - 1] == r:
            spans[r][-1]["end"] = int(we[k] - at[r])
        else:
            spans[r].append({"start": int(ws[k] - at[r]), "end": int(we[k] - at[r])})
    return np.bincount(row, minlength=n).tolist(), np.bincount(row[hit], minlength=n).tolist(), [sorted(items[r]) if r in items else [] for r in range(n)], [spans.get(r, []) for r in range(n)]


def contaminated(n_hit: str = "_n_hit", n_words: str = "_n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """`docs` without contaminated documents; from the others, the hit spans are cut."""
    n_words, n_hit, _, _ = names(docs.columns)
    return scan(docs, bench, n, cut=True).where(~contaminated(n_hit, n_words)).select(*[f"`{c}`" for c in docs.columns])


def _without(raw: bytes, spans: list[dict]) -> bytes:
    last, parts = 0, []
    for s in spans:
        parts.append(raw[last : s["start"]])
        last = s["end"]
    return b"".join([*parts, raw[last:]])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    s = scan(docs, read_table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return s.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def brute_force(docs: list[tuple], bench: list[tuple], n: int = N) -> list[tuple]:
    """The contract row by row, for tests."""
    import re

    pat = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: pat.findall(bytes(LOWER[np.frombuffer((t or "").encode(), np.uint8)]))
    wins = [(i, tuple(w[k : k + min(n, len(w))])) for i, t in bench for w in [split(t)] if w for k in range(len(w) - min(n, len(w)) + 1)]
    out = []
    for doc, text in docs:
        w, hit, items = split(text), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    items.add(i)
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE: dict[str, str] = {}
