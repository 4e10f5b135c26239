"""Removal of repeated 100-byte strings.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
smaller doc_id or earlier in the same document.  Strings never cross documents, are
judged on the input, and overlaps count.

The collection is cut by ranges of doc_id into chunks in order.  Each round sends
sorted distinct 64-bit hashes from chunks to hash buckets and gets a flag for each of
them back, as a file for each chunk; text is never shuffled after the first cut.

  round 1: every string of LENGTH bytes holds a smallest K-gram (winnowing); equal
           strings hold the same one.  A K-gram that stands nowhere else in the
           collection clears all strings that it is the smallest of.
  round 2: for strings left, whether an earlier chunk has the same; inside a chunk
           the earliest is known at once.  The bucket is of a second, independent
           hash, so that 64 + log2(buckets) bits stand for a string.

README says why this is not the column-wise Burrows-Wheeler construction.

Contract for odd rows: null and empty text has no bytes and loses none; text shorter
than LENGTH bytes loses none; rows with a null doc_id count as last, in no order of
their own (so of equal ones all but one lose); of rows that share a doc_id the one
with the smaller text starts earlier; extra columns are not read; an empty table
gives none."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_partitions, materialize, open_fs, pick, read_table, scratch_path, write_file
from .kernels import U64, mix, powers, prefix_sums, row_slices, text_buffers, trim

LENGTH, K = 100, 36
#: Bytes of text in a chunk, and strings in a bucket.
CHUNK, BUCKET = 8 << 20, 1 << 21
_SECOND = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _second_sums(data: np.ndarray) -> np.ndarray:
    s = np.empty(len(data) + 1, U64)
    s[0] = 0
    np.cumsum(_SECOND[data] * powers(len(data) + 1)[0][: len(data)], dtype=U64, out=s[1:])
    return s


def _fixed(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n bytes in a row."""
    m = len(sums) - n
    return mix((sums[n:] - sums[:-n]) * powers(len(sums))[1][:m]) if m > 0 else np.zeros(0, U64)


def smallest(g: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive hashes the place of the least of them, the first of equals."""
    x = (g & ~U64((1 << 24) - 1)) | np.arange(len(g), dtype=U64)
    n, have = len(g) - w + 1, 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < w:
        x = np.minimum(x[: n], x[w - have : w - have + n])
    return (x[:n] & U64((1 << 24) - 1)).astype(np.int64)


def strings(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """For slices of rows: (bytes, place of the slice, starts of its strings in it, place of
    each one's smallest K-gram, hashes of K-grams, sums).  Longer rows come in parts
    that overlap by a string less a byte."""
    for i, j in row_slices(offsets, 1 << 20):
        for lo in range(int(offsets[i]), int(offsets[j]), 1 << 22):
            part = data[lo : min(lo + (1 << 22) + length - 1, offsets[j])]
            if len(part) < length:
                continue
            ok = np.zeros(len(part) - length + 1, bool)
            for a, b in zip((offsets[i:j] - lo).tolist(), (offsets[i + 1 : j + 1] - lo).tolist()):
                ok[max(a, 0) : max(a, b - length + 1, 0)] = True
            starts = np.flatnonzero(ok)
            if len(starts):
                yield _slice(part, lo, starts, length, k)


def _slice(part, lo, starts, length, k):
    sums = prefix_sums(part)
    g = _fixed(sums, k)
    return part, lo, starts, smallest(g, length - k + 1)[starts], g, sums


def _places(small: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n, bool)
    mark[small] = True
    return np.flatnonzero(mark)


def _exchange(entries: DataFrame, tell, path: str) -> DataFrame:
    """Entries (bucket, chunk, keys) to buckets, flags by `tell` back as one file a chunk,
    by bucket; the files' names.  A file has a name of its own for each attempt."""

    def answer(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk").to_pylist()
        keys = [np.frombuffer(x, U64) for x in t.column("keys").to_pylist()]
        more = [np.frombuffer(x, np.uint8) for x in t.column("more").to_pylist()]
        flags = tell(chunk, keys, more)
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})

    def save(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        chunk = t.column("chunk")[0].as_py()
        own = f"{path}/{chunk}-{uuid.uuid4().hex}"
        write_file(own, t.column("flags").to_pylist())
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "file": pa.array([own])})

    replies = entries.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, flags binary")
    return materialize(replies.groupBy("chunk").applyInArrow(save, "chunk long, file string"), "replies")


def _by_bucket(keys: np.ndarray, bucket: np.ndarray):
    """Order by (bucket, key), and the bounds of buckets."""
    o = np.lexsort((keys, bucket))
    b = bucket[o]
    s = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    return o, b[s].astype(np.int64), s, np.append(s[1:], len(b))


def _flags(file: str, counts: list[int]) -> np.ndarray:
    """All flags of a chunk, in the order of its entries."""
    fs, inner = open_fs(file)
    with fs.open_input_stream(inner) as s:
        raw = np.frombuffer(s.read(), np.uint8)
    out, i = [], 0
    for n in counts:
        k = (n + 7) // 8
        out.append(np.unpackbits(raw[i : i + k], count=n).astype(bool))
        i += k
    return np.concatenate([*out, np.zeros(0, bool)])


def _anchors(data, offsets, buckets):
    """Round 1 of a chunk: distinct smallest K-grams by (bucket, hash), whether each
    stands at two places, and the buckets' sizes."""
    got = []
    for _, _, _, small, g, _ in strings(data, offsets):
        got.append(g[_places(small, len(g))])
    u, c = np.unique(np.concatenate([*got, np.zeros(0, U64)]), return_counts=True)
    o, b, s, e = _by_bucket(u, (u >> U64(7)) % U64(buckets))
    return u[o], c[o] > 1, b, s, e


def _candidates(data, offsets, buckets: int, flags) -> np.ndarray:
    """Round 2 of a chunk: a mark at the start of each string whose smallest K-gram
    stands elsewhere too; `flags` tells that of round 1's keys."""
    held, got = [], []
    for _, lo, starts, small, g, _ in strings(data, offsets):
        place = _places(small, len(g))
        held.append((lo, starts.astype(np.int32), small.astype(np.int32), place.astype(np.int32), g[place]))
    u = np.unique(np.concatenate([*(x[4] for x in held), np.zeros(0, U64)]))
    o, _, s, e = _by_bucket(u, (u >> U64(7)) % U64(buckets))
    known = np.sort(u[o][flags((e - s).tolist())])
    mark = np.zeros(len(data), bool)
    for lo, starts, small, place, g in held:
        if len(known):
            hit = np.zeros(int(place[-1]) + 1, bool)
            hit[place] = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
            mark[starts[hit[small]].astype(np.int64) + lo] = True
    return mark


def _string_hashes(data, mark: np.ndarray):
    """Marked starts and both hashes of the strings there."""
    at, h, h2 = [], [], []
    for lo in range(0, len(data), 1 << 20):
        own = np.flatnonzero(mark[lo : lo + (1 << 20)])
        if len(own):
            part = data[lo : lo + (1 << 20) + LENGTH]
            inv = powers(len(part) + 1)[1][own]
            at.append(own + lo)
            for sums, out in ((prefix_sums(part), h), (_second_sums(part), h2)):
                out.append(mix((sums[own + LENGTH] - sums[own]) * inv))
    z = np.zeros(0, U64)
    return np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*h, z]), np.concatenate([*h2, z])


def _marks(path: str, n: int) -> np.ndarray:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as s:
        return np.unpackbits(np.frombuffer(zlib.decompress(s.read()), np.uint8), count=n).astype(bool)


def chunks_of(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Chunks in order of doc_id: chunk, ids, nulls, lens, data."""
    n = default_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, ids, lens, data, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.large_binary() if size > 1 << 31 else pa.binary())], names=["chunk", "ids", "lens", "data"])

        for b in batches:
            raw, off = text_buffers(b.column("text"))
            doc = b.column("doc_id").to_pylist()
            for i in range(len(doc)):
                ids.append(doc[i])
                lens.append(int(off[i + 1] - off[i]))
                data.append(raw[off[i] : off[i + 1]].tobytes())
                size += lens[-1]
                if size >= chunk_bytes:
                    yield flush()
                    k, ids, lens, data, size = k + 1, [], [], [], 0
        if ids:
            yield flush()
        del data
        trim()

    ranged = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_last(), "text").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    return ranged.mapInArrow(run, "chunk long, ids array<long>, lens array<long>, data binary")


def _rows(b: pa.RecordBatch, *more: str):
    for row in zip(*(b.column(c) for c in ("chunk", "data", "lens", *more)), strict=True):
        data = np.frombuffer(row[1].as_buffer(), np.uint8)
        yield row[0].as_py(), data, np.concatenate([[0], np.cumsum(np.array(row[2].as_py(), np.int64))]).astype(np.int64), *(x.as_py() for x in row[3:])


def _entries(chunk: int, keys: np.ndarray, more: np.ndarray | None, b, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([chunk] * len(b), pa.int64()), pa.array([keys[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary()), pa.array([np.packbits(more[x:y]).tobytes() if more is not None else b"" for x, y in zip(s, e, strict=True)], pa.binary())], names=["bucket", "chunk", "keys", "more"])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text bytes and removed spans: doc_id, n_bytes, spans (array of start, end
    in UTF-8 bytes), kept (the remaining bytes)."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = materialize(chunks_of(docs), "chunks")
    b1 = max(default_partitions(spark), int(total) // (16 * BUCKET) + 1)
    b2 = max(default_partitions(spark), int(total) // (2 * BUCKET) + 1)

    def send_anchors(batches):
        for batch in batches:
            for chunk, data, off in _rows(batch):
                keys, twice, b, s, e = _anchors(data, off, b1)
                if len(b):
                    yield _entries(chunk, keys, twice, b, s, e)
        trim()

    def more_than_once(chunk, keys, more):
        everything = np.sort(np.concatenate(keys))
        again = everything[1:][everything[1:] == everything[:-1]]
        return [np.unpackbits(m, count=len(k)).astype(bool) | (np.isin(k, again)) for k, m in zip(keys, more, strict=True)]

    entry = "bucket long, chunk long, keys binary, more binary"
    first = _exchange(chunks.mapInArrow(send_anchors, entry), more_than_once, scratch_path(spark, "anchors"))

    marks = scratch_path(spark, "marks")

    def send_strings(batches):
        for batch in batches:
            for chunk, data, off, file in _rows(batch, "file"):
                mark = _candidates(data, off, b1, lambda counts, file=file: _flags(file, counts) if file else np.zeros(sum(counts), bool))
                # The same bytes whenever this task runs again; round 3 need not find them anew.
                write_file(f"{marks}/{chunk}", [zlib.compress(np.packbits(mark).tobytes(), 1)])
                _, h, h2 = _string_hashes(data, mark)
                del mark
                u, at = np.unique(h, return_index=True)
                o, b, s, e = _by_bucket(u, h2[at] % U64(b2))
                if len(b):
                    yield _entries(chunk, u[o], None, b, s, e)
        trim()

    def earlier(chunk, keys, _):
        order = np.argsort(chunk, kind="stable")
        allk = np.concatenate([keys[i] for i in order])
        _, at = np.unique(allk, return_index=True)  # the first of equals is of the earliest chunk
        new = np.zeros(len(allk), bool)
        new[at] = True
        ends = np.cumsum([0, *(len(keys[i]) for i in order)])
        flags: list = [None] * len(keys)
        for x, i in enumerate(order):
            flags[i] = ~new[ends[x] : ends[x + 1]]
        return flags

    with_first = chunks.join(first, "chunk", "left")  # a row for each 8 MB of text: Spark broadcasts the names while they are few
    second = _exchange(with_first.mapInArrow(send_strings, entry), earlier, scratch_path(spark, "strings"))
    with_both = chunks.join(second.withColumnRenamed("file", "file2"), "chunk", "left")

    def cut(batches):
        for batch in batches:
            for (chunk, data, off, file2), ids in zip(_rows(batch, "file2"), batch.column("ids").to_pylist(), strict=True):
                at, h, h2 = _string_hashes(data, _marks(f"{marks}/{chunk}", len(data)))
                u, place, inv = np.unique(h, return_index=True, return_inverse=True)
                lost = np.ones(len(h), bool)
                lost[place] = False
                if file2:
                    o, _, s, e = _by_bucket(u, h2[place] % U64(b2))
                    flag = np.zeros(len(u), bool)
                    flag[o] = _flags(file2, (e - s).tolist())
                    lost |= flag[inv]
                mark = np.zeros(len(data) + 1, np.int32)
                mark[at[lost]] += 1
                np.subtract.at(mark, at[lost] + LENGTH, 1)
                gone = np.cumsum(mark[:-1]) > 0
                out = []
                for r, doc in enumerate(ids):
                    g = gone[off[r] : off[r + 1]]
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                    out.append((doc, len(g), [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)], data[off[r] : off[r + 1]][~g].tobytes()))
                for k in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out[k : k + 2000], strict=True), (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])
        trim()

    return with_both.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = removed(read_table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return r.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract string by string, for tests."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


QUERIES = {"op7_substrings": op7_substrings}
ORACLE: dict[str, str] = {}
