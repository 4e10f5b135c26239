"""Token ids in sorted-string-table shards.

Documents are keyed by their id (8 bytes, big-endian, order preserving) in
prefix-compressed blocks, with a sparse block index, a Bloom filter and a footer
in each shard.  Shards hold ascending, disjoint key ranges.

Contract for odd rows: null or empty text has no ids but the end id; a null
doc_id can't be a key, so such a row is not written; rows that share a doc_id are
all written, in order of their text; extra columns are not read.  No rows, no
shards."""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_partitions, materialize, open_fs, pick, read_table, scratch_path, tokenizer_path, write_file
from .kernels import regrouped, text_buffers, trim
from .tokens import encoder

MAGIC = b"QFSST001"
#: Bytes of entries in a block before it is compressed, and of blocks in a shard.
BLOCK, SHARD = 1 << 16, 256 << 20
#: Every so many entries of a block stand with their whole key.
RESTART = 16
#: Bits of the Bloom filter for each key, and its hash functions.
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: index offset, index bytes, bloom offset, bloom bytes, entries, ids, magic
FOOTER = struct.Struct("<QQQQQQ8s")
END_ID = 0


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = s = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << s
        if x < 128:
            return n, i
        s += 7


def _pack_ids(ids: np.ndarray) -> bytes:
    """Width byte and ids: 2 bytes each if all fit, else 4."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()


def _unpack_ids(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4" if b[0] == 4 else "<u2", offset=1).astype(np.uint32)


def _bloom_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    from .kernels import mix

    a = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27))
    b = mix(a) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class TableWriter:
    """Builds one shard; add() takes keys in ascending order."""

    def __init__(self) -> None:
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=3)
        self.offset, self.n_ids = 0, 0
        self.keys: list[int] = []
        self.index: list[tuple[bytes, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.buf, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[bytes]:
        key = key_of(doc_id)
        shared = 0
        if self.count % RESTART:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.buf))
        if not self.count:
            self.first = key
        value = _pack_ids(ids)
        self.buf += bytes([shared, 8 - shared]) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        self.keys.append(doc_id)
        self.n_ids += len(ids)
        if len(self.buf) >= BLOCK:
            yield self._block()

    def _block(self) -> bytes:
        raw = bytes(self.buf) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        out = self.zip.compress(raw)
        out += struct.pack("<I", zlib.crc32(out))
        self.index.append((self.first, self.offset, len(out)))
        self.offset += len(out)
        self._open()
        return out

    def finish(self) -> Iterator[bytes]:
        if self.count:
            yield self._block()
        index = b"".join(struct.pack("<8sQQ", *x) for x in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        if self.keys:
            at = _bloom_bits(np.array(self.keys), bits).ravel()
            np.bitwise_or.at(bloom, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        tail = struct.pack("<Q", bits) + bloom.tobytes()
        yield index + tail + FOOTER.pack(self.offset, len(index), self.offset + len(index), len(tail), len(self.keys), self.n_ids, MAGIC)


class TableReader:
    """Point lookups and scans over one shard."""

    def __init__(self, path: str):
        import zstandard

        self.zip = zstandard.ZstdDecompressor()
        fs, inner = open_fs(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        i, ni, b, nb, self.n_keys, self.n_ids, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no table of ours")
        raw = self.file.read_at(ni, i)
        self.index = [struct.unpack_from("<8sQQ", raw, k) for k in range(0, ni, 24)]
        self.bloom = (b, nb)

    def _block(self, k: int) -> bytes:
        _, at, n = self.index[k]
        raw = self.file.read_at(n, at)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        return self.zip.decompress(raw[:-4])

    @staticmethod
    def _entries(block: bytes, start: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end = len(block) - 4 - 4 * struct.unpack("<I", block[-4:])[0]
        i, key = start, b""
        while i < end:
            shared, own = block[i], block[i + 1]
            n, i = _read_varint(block, i + 2)
            key = key[:shared] + block[i : i + own]
            i += own
            yield key, block[i : i + n]
            i += n

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._entries(self._block(k)):
                yield id_of(key), _unpack_ids(value)

    def may_have(self, doc_id: int) -> bool:
        raw = self.file.read_at(self.bloom[1], self.bloom[0])
        bits = struct.unpack("<Q", raw[:8])[0]
        return all(raw[8 + (int(x) >> 3)] >> (int(x) & 7) & 1 for x in _bloom_bits(np.array([doc_id]), bits)[0])

    def get(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first entry with this key; None if there is none."""
        key = key_of(doc_id)
        if not self.index or not self.may_have(doc_id):
            return None
        k = max(0, bisect.bisect_left([x[0] for x in self.index], key) - 1)
        for block_at in range(k, min(k + 2, len(self.index))):
            block = self._block(block_at)
            n = struct.unpack("<I", block[-4:])[0]
            restarts = struct.unpack(f"<{n}I", block[-4 - 4 * n : -4])
            heads = [next(self._entries(block, r))[0] for r in restarts]
            for found, value in self._entries(block, restarts[max(0, bisect.bisect_left(heads, key) - 1)]):
                if found == key:
                    return _unpack_ids(value)
                if found > key:
                    break
        return None


def write_tables(docs: DataFrame, out_dir: str, vocabulary: str, end_id: int = END_ID, shards: int | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """Write `docs` (doc_id, text) as shards under `out_dir`; the manifest, one row
    a shard: shard, path, n_docs, n_ids, bytes, first_id, last_id.

    A task starts a new shard where one has `shard_bytes`, so shards stay small however
    much a task has.  Files have names of their own for each attempt and only those in
    the manifest count, so a task that runs again does no harm."""
    n = shards or default_partitions(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, ends = encoder(vocabulary), np.array([end_id], np.uint32)
        part, k = TaskContext.get().partitionId(), 0

        def rows():
            for b in regrouped(batches, enc.BYTES):
                data, off = text_buffers(b.column("text"))
                doc_ids = b.column("doc_id").to_pylist()
                for first, ids, at in enc.rows(data, off):
                    for r in range(len(at) - 1):
                        yield doc_ids[first + r], np.concatenate([ids[at[r] : at[r + 1]], ends])

        todo = rows()
        row = next(todo, None)

        def shard(w: TableWriter):
            nonlocal row
            while row is not None and w.offset < shard_bytes:
                yield from w.add(*row)
                row = next(todo, None)
            yield from w.finish()

        while row is not None:
            w, path = TableWriter(), f"{out_dir}/shard-{part:06d}-{k:04d}-{uuid.uuid4().hex}.sst"
            size = write_file(path, shard(w))
            yield pa.RecordBatch.from_pydict({"shard": [part << 20 | k], "path": [path], "n_docs": [len(w.keys)], "n_ids": [w.n_ids], "bytes": [size], "first_id": [w.keys[0]], "last_id": [w.keys[-1]]})
            k += 1
        trim()

    rows = pick(docs, "doc_id", "text").where("doc_id is not null")
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_ids long, bytes long, first_id long, last_id long"), "sst-manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """What the shards hold: doc_id, start (ids before it), n_tokens, ids_crc32, shard."""
    n = max(1, default_partitions(manifest.sparkSession))
    starts: list[tuple] = []
    before = 0
    for r in sorted(manifest.select("first_id", "shard", "path", "n_ids").collect()):  # a row for each file
        starts.append((r["shard"], r["path"], before))
        before += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, start in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "start")), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in TableReader(path).scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    spark = manifest.sparkSession
    files = spark.createDataFrame(starts, "shard long, path string, start long")
    return files.repartition(min(n, max(1, len(starts))), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=list(names))


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return read_tables(write_tables(docs, scratch_path(spark, "sst"), tokenizer_path("byte_bpe_50k.json")))


QUERIES = {"op1_sstable": op1_sstable}
ORACLE: dict[str, str] = {}
