"""Cost-balanced packing of token ids into sequences.

The attention cost of a piece of n tokens is taken as LINEAR * n + QUADRATIC * n * n.
Documents are encoded and packed block by block in the task that reads them (no
shuffle): whole pieces of the sequence length stand alone, the others are assigned
in descending order to the open sequence of lowest cost that has room; what fits
nowhere is cut to fill the room that is left.  One block's last open sequences take
documents of the next block, so a task ends with less than one part-filled
sequence for each.

Contract for odd rows: null or empty text is the end id alone; rows with a null
doc_id are packed too (their pieces have a null doc_id); repeated rows are packed
as often as they stand; extra columns are not read; no rows, no pieces."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, read_table, tokenizer_path
from .kernels import regrouped, text_buffers, trim
from .tokens import encoder

LENGTH, END_ID = 2048, 1
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Ids that are packed together.
BLOCK_IDS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Open:
    """Open sequences by the room that is left: a heap of (cost, sequence) for each room,
    and over the heaps' tops a tree of minima, so that the cheapest with room is exact."""

    NONE = (float("inf"), -1, 0)

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        #: Least (cost, sequence, room) below each node; leaf size + r is of room r.
        self.tree = [self.NONE] * (2 * self.size)

    def _update(self, room: int) -> None:
        tree, heap = self.tree, self.heaps[room]
        i, top = self.size + room, (*heap[0], room) if heap else self.NONE
        tree[i] = top
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            top = top if top < other else other
            if tree[i] == top:
                return
            tree[i] = top

    def put(self, cost_: float, sequence: int, room: int) -> None:
        if room:
            heap = self.heaps[room]
            heapq.heappush(heap, (cost_, sequence))
            if heap[0][1] == sequence:
                self._update(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """The cheapest sequence with at least so much room, which is then no longer open."""
        tree, best = self.tree, self.NONE
        lo, hi = self.size + room, 2 * self.size
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo, hi = lo >> 1, hi >> 1
        if best is self.NONE:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._update(best[2])
        return best

    def take_emptiest(self) -> tuple[float, int, int] | None:
        for room in range(len(self.heaps) - 1, 0, -1):
            if self.heaps[room]:
                return self.take(room)
        return None

    def room(self) -> int:
        return sum(room * len(h) for room, h in enumerate(self.heaps))


class Packer:
    """Packs the documents of one task.  Sequences have ids of their own from `first`."""

    def __init__(self, first: int, length: int = LENGTH):
        self.length, self.next = length, first
        self.open = Open(length)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def pack(self, sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
        """Pieces (document, start, length, sequence, offset) of documents of these sizes."""
        n, out, rest = self.length, [], []
        for d, size in enumerate(sizes):
            full = size // n
            out += [(d, k * n, n, self._new(), 0) for k in range(full)]
            if size % n:
                rest.append((size % n, d, full * n))
        rest.sort(key=lambda x: (-x[0], x[1]))
        for _ in range(max(0, -(-(sum(x[0] for x in rest) - self.open.room()) // n))):
            self.open.put(0.0, self._new(), n)
        late = []
        for size, d, start in rest:
            got = self.open.take(size)
            if got is None:
                late.append((size, d, start))  # no sequence has room for all of it
                continue
            c, s, room = got
            out.append((d, start, size, s, n - room))
            self.open.put(c + cost(size), s, room - size)
        for size, d, start in late:
            while size:
                c, s, room = self.open.take_emptiest() or (0.0, self._new(), n)
                k = min(size, room)
                out.append((d, start, k, s, n - room))
                start, size = start + k, size - k
                self.open.put(c + cost(k), s, room - k)
        return out


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (doc_id, text): see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId() << 36, length)
        end = np.array([end_id], np.uint32)
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def flush():
            pieces = packer.pack([len(x) for _, x in held])
            cols = list(zip(*((held[d][0], start, k, zlib.crc32(held[d][1][start : start + k].astype("<u4").tobytes()), len(held[d][1]), s, at) for d, start, k, s, at in pieces), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in regrouped(batches, enc.BYTES):
            data, off = text_buffers(b.column("text"))
            doc_ids = b.column("doc_id").to_pylist()
            for first, ids, at in enc.rows(data, off):
                for k in range(len(at) - 1):
                    held.append((doc_ids[first + k], np.concatenate([ids[at[k] : at[k + 1]], end])))
                    n += len(held[-1][1])
                    if n >= BLOCK_IDS:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()
        del held
        trim()

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
