"""Exact Jaccard join of word n-gram sets, as a metric-space join with pivots.

Jaccard distance is a metric.  Unrelated texts share next to nothing, so they stand at
distance 1 from any pivot text and no window of whole-text pivots could part them;
the first level therefore takes single n-grams as pivots.  The set {s} is nearer than
1 to those texts only that hold s, and of a text's pivots those that a partner within
the radius must share - its prefix under one global order - are its window: it is
replicated to these regions and no others.  Texts with too few n-grams that any other
text has, have no partner and leave first.

  1. Sets as sorted 64-bit hashes; equal sets become one class (128-bit set hash).
  2. Prefixes (in hash order) are counted; a class whose prefix has too few n-grams
     known elsewhere leaves.  Exact: a partner shares so many by the prefix bound.
  3. For the rest whole sets are counted, n-grams ordered by frequency, and the
     prefix in that order gives the regions.  Rare n-grams come first, so passages
     that many texts share make no large regions.
  4. Regions with the same first text (by a hash order) are one cell of that pivot;
     each class goes to its first pivot's cell, cells join exactly; then the cells
     that still hold different components join whole.
  5. A cell of more than CELL members is split, spread over tasks of GROUP members.  It
     gets several whole texts as pivots, those first that nothing is linked to yet, and
     all members' distances to them.  Members within the radius are linked; a pivot has
     met everyone and leaves.  A member leaves if no partner outside its own component
     can be near: it is nearer to a pivot of its component than the nearest outsider
     less the radius.  The others go to the Voronoi region of their nearest pivot, and
     by the triangle inequality to all regions whose pivot is at most two radii
     farther; regions are cells and recurse.
  6. Where these windows replicate too much, members stand too far from all pivots to
     be told apart.  Then n-grams are counted again within the cell: members with too
     few that the cell knows leave, the others go to the cells of their rarest ones if
     that replicates less; if not, the cell stays and gets four times the pivots.
     Every level takes pivots out, so this comes to an end.

Links inside a task are reduced to a spanning forest, components come from stars.

Contract for odd rows: null or empty text has the empty set and is linked with
nothing; a null doc_id comes out with a null component; rows that share a doc_id are
judged each by its own set; extra columns are not read; an empty table gives none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import default_partitions, drop_table, materialize, pick, read_table, salted_lookup
from .components import components
from .kernels import LOWER, SPACE_WORD, U64, gram_hashes, mix, prefix_sums, row_slices, span_hashes, text_buffers, trim, words

K, PERCENT = 5, 80
RADIUS = 1 - PERCENT / 100
#: Members of a cell that one task joins; n-grams in a chunk; counted n-grams in a bucket.
CELL, CHUNK, BUCKET = 2048, 1 << 19, 1 << 20
#: n-grams of members that one task holds; beyond these a cell is split as well.
TOKENS = 1 << 21
#: Members of a larger cell that one task holds against its pivots; pivots at first and at most.
GROUP, PIVOTS, MOST_PIVOTS = 1024, 16, 1024
#: A split by windows, or by n-grams, is taken if members go to so many cells at most, on
#: average, and if it leaves at most so large a share of the pairs (sum of squared sizes).
REPLICATES, PAIRS = 1.5, 0.5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = K) -> Iterator[np.ndarray]:
    """For each row its sorted distinct hashes of k words, or of all words if fewer."""
    low = LOWER[data]
    ws, we, row = words(low, offsets, SPACE_WORD)
    h = span_hashes(prefix_sums(low), ws, we)
    g = gram_hashes(h, k)
    at = np.searchsorted(row, np.arange(len(offsets)))
    for r in range(len(offsets) - 1):
        a, b = int(at[r]), int(at[r + 1])
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        else:
            yield gram_hashes(h[a:b], b - a) if b > a else np.zeros(0, U64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(mix(s ^ U64(0xA5A5A5A5)).sum(dtype=U64).view(np.int64)), int(mix(s + U64(0x1234567)).sum(dtype=U64).view(np.int64))


def shared_least(n: int) -> int:
    """n-grams that a set of n shares with any set it is linked with."""
    return -(-PERCENT * n // 100)


def _extra(n: int) -> int:
    return max(1, n // 10)


def prefix_length(n: int) -> int:
    return min(n, n - shared_least(n) + _extra(n))


def prefix_shared_least(n: int) -> int:
    """Prefix n-grams that a linked set's prefix holds too (the smaller extra of the two)."""
    return min(_extra(n), _extra(shared_least(n)))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, off = text_buffers(batch.column("text"))
    ids, i = batch.column("doc_id").to_pylist(), 0
    for a, b in row_slices(off):
        for s in shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a]):
            yield ids[i], s
            i += 1


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, h1, h2 for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), *set_hash(s)) for _, s in _sets(b)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "th", "n", "h1", "h2"])
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, n long, h1 long, h2 long")


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)


def known_elsewhere(docs: DataFrame, buckets: int) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, known), and the tables it reads; known: how many prefix n-grams of the
    document another one's prefix has.
    Tasks send each of their n-grams once; 32 bits in one of `buckets` stand for an
    n-gram, which can only make more of them known."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        toks: list[np.ndarray] = []
        ids: list[int] = []
        lens: list[int] = []
        n, chunk = 0, TaskContext.get().partitionId() << 32

        def flush():
            t, d = np.concatenate(toks), np.repeat(np.array(ids, np.int64), lens)
            order = np.argsort(t, kind="stable")
            t, d = t[order], d[order]
            start = _runs(t)
            size = np.diff(np.append(start, len(t)))
            # A document's n-grams are distinct, but one doc_id can stand twice.
            dup = np.repeat(size > 1, size)
            u, c = np.unique(d[dup], return_counts=True)
            out = [(-1, chunk, b"", u.tobytes(), c.astype(np.int32).tobytes())] if len(u) else []
            one, many = start[size == 1], start[size > 1]
            for at, own in ((one, True), (many, False)):
                if not len(at):
                    continue
                bucket = (t[at] >> U64(32)) % U64(buckets)
                o = np.argsort(bucket, kind="stable")
                b, tk, dd = bucket[o].astype(np.int64), (t[at][o] & U64(0xFFFFFFFF)).astype(np.uint32), d[at][o]
                s = _runs(b)
                for x, y in zip(s, np.append(s[1:], len(b)), strict=True):
                    by = np.argsort(dd[x:y], kind="stable")
                    out.append((int(b[x]), chunk, tk[x:y][by].tobytes(), dd[x:y][by].tobytes() if own else b"", b""))
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "toks", "ids", "counts"])

        for b in batches:
            for i, s in _sets(b):
                if len(s):
                    toks.append(s[: prefix_length(len(s))])
                    ids.append(i)
                    lens.append(len(toks[-1]))
                    n += lens[-1]
                    if n >= 4 * CHUNK:
                        yield flush()
                        toks, ids, lens, n, chunk = [], [], [], 0, chunk + 1
        if toks:
            yield flush()
        del toks
        trim()

    def count(t: pa.Table) -> pa.Table:
        toks = [np.frombuffer(x, np.uint32) for x in t.column("toks").to_pylist()]
        own = t.column("own").to_pylist()
        z = np.zeros(0, np.uint32)
        allt = np.sort(np.concatenate([*toks, z]))
        again = np.unique(np.concatenate([allt[1:][allt[1:] == allt[:-1]], *(x for x, o in zip(toks, own, strict=True) if not o)]))
        flags = [np.packbits(np.isin(x, again)).tobytes() if o else b"" for x, o in zip(toks, own, strict=True)]
        return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "own": t.column("own"), "flags": pa.array(flags, pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        """A chunk's documents with all that is known of them."""
        got, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d, c, f in zip(*(t.column(x).to_pylist() for x in ("ids", "counts", "flags")), strict=True):
            d = np.frombuffer(d, np.int64)
            if c:
                got.append(d)
                n.append(np.frombuffer(c, np.int32).astype(np.int64))
            elif f:
                got.append(d[np.unpackbits(np.frombuffer(f, np.uint8), count=len(d)).astype(bool)])
                n.append(np.ones(len(got[-1]), np.int64))
        u, at = np.unique(np.concatenate(got), return_inverse=True)
        return pa.table({"doc_id": pa.array(u, pa.int64()), "known": pa.array(np.bincount(at, np.concatenate(n), minlength=len(u)).astype(np.int64), pa.int64())})

    sent = materialize(docs.mapInArrow(send, "bucket long, chunk long, toks binary, ids binary, counts binary"), "prefixes")
    own = F.octet_length("ids") > 0
    reply = sent.where("bucket >= 0").select("bucket", "chunk", "toks", own.alias("own")).groupBy("bucket").applyInArrow(count, "bucket long, chunk long, own boolean, flags binary")
    flags = materialize(reply.where("own").select("bucket", "chunk", "flags"), "prefix-flags")
    mine = sent.where(own).select("bucket", "chunk", "ids", "counts").join(flags, ["bucket", "chunk"], "left")
    return mine.groupBy("chunk").applyInArrow(gather, "doc_id long, known long").groupBy("doc_id").agg(F.sum("known").alias("known")), [sent, flags]


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the sets of the classes in `wanted` (doc_id, h1, rep): chunk, ids (reps),
    lens, toks.  Where rows are repeated a task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids, sets, n, sent = [], [], 0, set()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array([len(s) for s in sets], np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(sets).tobytes()], pa.binary())], names=["chunk", "ids", "lens", "toks"])

        for b in batches:
            h1, rep = b.column("_h1").to_pylist(), b.column("_rep").to_pylist()
            for i, (_, s) in enumerate(_sets(b)):
                if set_hash(s)[0] == h1[i] and rep[i] not in sent:
                    sent.add(rep[i])
                    ids.append(rep[i])
                    sets.append(s)
                    n += len(s)
                if n >= CHUNK:
                    yield flush()
                    k, ids, sets, n = k + 1, [], [], 0
        if ids:
            yield flush()
        del sets
        trim()

    w = wanted.select("doc_id", F.col("h1").alias("_h1"), F.col("rep").alias("_rep"))
    return docs.join(w, "doc_id").select("doc_id", "text", "_h1", "_rep").mapInArrow(run, "chunk long, ids binary, lens binary, toks binary")


def _short(toks: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high and 32 bits of the n-gram in the low half."""
    return ((toks >> U64(32)) % U64(buckets)) << U64(32) | (toks & U64(0xFFFFFFFF))


def regions(chunks: DataFrame, buckets: int) -> DataFrame:
    """rep, n, set (8 bytes an n-gram), regions (array of long) for the sets that can
    have a partner: those with enough n-grams that another set has, and the pivots of
    their prefix, rarest first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, toks in zip(b.column("chunk").to_pylist(), b.column("toks").to_pylist(), strict=True):
                u, c = np.unique(_short(np.frombuffer(toks, U64), buckets), return_counts=True)
                hi = (u >> U64(32)).astype(np.int64)
                s = _runs(hi)
                e = np.append(s[1:], len(u))
                yield pa.RecordBatch.from_arrays([pa.array(hi[s]), pa.array([chunk] * len(s), pa.int64()), pa.array([(u[x:y] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() for x, y in zip(s, e, strict=True)], pa.binary()), pa.array([c[x:y].astype(np.int32).tobytes() for x, y in zip(s, e, strict=True)], pa.binary())], names=["bucket", "chunk", "toks", "counts"])

    def count(t: pa.Table) -> pa.Table:
        toks = [np.frombuffer(x, np.uint32) for x in t.column("toks").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in t.column("counts").to_pylist()])
        u, inv = np.unique(np.concatenate(toks), return_inverse=True)
        df = np.minimum(np.bincount(inv, counts, minlength=len(u)), 2**31 - 1).astype(np.int32)[inv]
        at = np.cumsum([0, *map(len, toks)])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "df": pa.array([df[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lens, toks, reply in zip(*(b.column(c).to_pylist() for c in ("ids", "lens", "toks", "reply")), strict=True):
                ids, lens, toks = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64), np.frombuffer(toks, U64)
                short = _short(toks, buckets)
                u, inv = np.unique(short, return_inverse=True)
                df = np.concatenate([np.frombuffer(r["df"], np.int32) for r in sorted(reply, key=lambda r: r["bucket"])])[inv]
                at = np.concatenate([[0], np.cumsum(lens)])
                out = []
                for i in range(len(ids)):
                    d, s = df[at[i] : at[i + 1]], short[at[i] : at[i + 1]]
                    n = len(d)
                    if int((d > 1).sum()) < shared_least(n):
                        continue
                    first = np.lexsort((s, d))[: n - shared_least(n) + 1]
                    chosen = np.unique(s[first][d[first] > 1]).view(np.int64)
                    if len(chosen):
                        out.append((int(ids[i]), n, toks[at[i] : at[i + 1]].tobytes(), chosen.tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["rep", "n", "set", "regions"])

    sent = chunks.select("chunk", "toks").mapInArrow(send, "bucket long, chunk long, toks binary, counts binary")
    reply = sent.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, df binary").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "df")).alias("reply"))
    return chunks.join(reply, "chunk").mapInArrow(choose, "rep long, n long, set binary, regions array<long>")


def _common(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of the sets `a` with the sets `b`, or with each other."""
    both = a + (b or [])
    u, inv, c = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    col = np.where(c > 1, np.cumsum(c > 1) - 1, -1)[inv]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    m, n = len(a), len(b) if b is not None else len(a)
    out = np.zeros((m, n), np.float32)
    width = max(256, min(8192, (1 << 24) // max(1, len(both))))
    for x in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (x, x + width))
        block = np.zeros((len(both), width), np.float32)
        block[row[i:j], col[i:j] - x] = 1
        out += block[:m] @ (block[m:] if b is not None else block).T
    return out.astype(np.int64)


def _linked(both: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (n[:, None] + k[None, :] - both)


class Union:
    """Disjoint sets of numbers; the least stands for each."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, i: int) -> int:
        path = []
        while (up := self.root.get(i, i)) != i:
            path.append(i)
            i = up
        for x in path:
            self.root[x] = i
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)
        return a != b

    def star(self) -> list[tuple[int, int]]:
        """Each number that is not the least of its set, and the least."""
        return [(i, r) for i in list(self.root) if (r := self.find(i)) != i]


def _forest(sets: list[np.ndarray], ids: list[int]) -> list[tuple[int, int]]:
    """Spanning links of the exact join of some sets: stars, which components() ends with."""
    lens = np.array([len(s) for s in sets], np.int64)
    at, u = np.nonzero(np.triu(_linked(_common(sets), lens, lens), 1)), Union()
    for i, j in zip(*(x.tolist() for x in at), strict=True):
        u.join(ids[i], ids[j])
    return u.star()


def _links(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})


def join_cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Spanning links (u, v) of the exact joins of small cells (cell, rep)."""

    def run(t: pa.Table) -> pa.Table:
        return _links(_forest([np.frombuffer(x, U64) for x in t.column("set").to_pylist()], t.column("rep").to_pylist()))

    return members.select("cell", "rep").join(sets.select("rep", "set"), "rep").groupBy("cell").applyInArrow(run, "u long, v long")


_MEASURED = "cell long, salt int, width int, reps binary, labs binary, pivots binary, plabs binary, d binary, links binary, merged binary"
_MEMBERS = "cell long, rep long, lab long, width int"


def measure(large: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Large cells (cell, rep, lab, width, n, size, total) against their pivots.  A row for
    each GROUP of a cell: its members and their components' names, the cell's pivots and
    theirs, all distances, links (a spanning forest of members and pivots), and names
    that a link makes one.  A member that has its own name counts as not linked yet."""
    spread = F.ceil(F.greatest(F.col("size") / GROUP, F.col("total") / TOKENS)).cast("int")
    order = Window.partitionBy("cell").orderBy(F.col("lab") != F.col("rep"), F.xxhash64("rep", F.lit(level)), "rep")
    chosen = large.withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= F.col("width")) & (F.col("nth") <= MOST_PIVOTS))
    chosen = chosen.withColumn("so_far", F.sum("n").over(Window.partitionBy("cell").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))).where(f"nth = 1 or so_far <= {TOKENS}")
    pivots = materialize(chosen.select("cell", "rep", "lab", spread.alias("groups")).join(sets.select("rep", "set"), "rep"), "jaccard-pivots")
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    members = large.withColumn("salt", F.pmod(F.xxhash64("rep"), spread).cast("int")).join(sets.select("rep", "set"), "rep")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _MEASURED.split(", ")]
        if not a.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c == "cell" else pa.int32() if c in ("salt", "width") else pa.binary()) for c in names})
        b = b.sort_by("rep")
        reps, labs = (a.column(c).to_numpy() for c in ("rep", "lab"))
        pivots, plabs = (b.column(c).to_numpy() for c in ("rep", "lab"))
        x, y = ([np.frombuffer(v, U64) for v in t.column("set").to_pylist()] for t in (a, b))
        n, k = (np.array([len(s) for s in z], np.int64) for z in (x, y))
        both = _common(x, y)
        d = (1 - both / (n[:, None] + k[None, :] - both)).astype(np.float32)
        at = np.nonzero(_linked(both, n, k))
        links, names_, merged = Union(), Union(), []
        own, labs = (labs == reps) & ~np.isin(reps, pivots), labs.copy()
        for i, j in zip(*(z.tolist() for z in at), strict=True):
            links.join(int(reps[i]), int(pivots[j]))
            if own[i]:  # no one else has its name: it takes that of its first pivot
                labs[i], own[i] = plabs[j], False
            elif names_.join(int(labs[i]), int(plabs[j])):
                merged.append((int(labs[i]), int(plabs[j])))
        out = {"cell": a.column("cell")[0].as_py(), "salt": a.column("salt")[0].as_py(), "width": a.column("width")[0].as_py(), "reps": reps.tobytes(), "labs": labs.tobytes(), "pivots": pivots.tobytes(), "plabs": plabs.tobytes(), "d": d.tobytes(), "links": np.array(links.star(), np.int64).tobytes(), "merged": np.array(merged, np.int64).tobytes()}
        return pa.table({c: pa.array([v], pa.int64() if c == "cell" else pa.int32() if c in ("salt", "width") else pa.binary()) for c, v in out.items()})

    return materialize(members.groupBy("cell", "salt").cogroup(pivots.groupBy("cell", "salt")).applyInArrow(run, _MEASURED), "jaccard-measured")


def _one(t: pa.Table, cell: int, **blobs: np.ndarray) -> pa.Table:
    return pa.table({"cell": pa.array([cell], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()}})


def _named(names: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """`names` with the new ones for the old (sorted)."""
    if not len(old):
        return names
    at = np.minimum(np.searchsorted(old, names), len(old) - 1)
    return np.where(old[at] == names, new[at], names)


def split_cells(seen: DataFrame) -> DataFrame:
    """What stays of measured cells: cell, rep, lab, width, cells (regions' cells; null
    where windows replicate too much, and for the whole cell then)."""

    def unite(t: pa.Table) -> pa.Table:
        u = Union()
        for raw in t.column("merged").to_pylist():
            for a, b in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist():
                u.join(a, b)
        old = np.array(sorted(u.root), np.int64)
        return _one(t, t.column("cell")[0].as_py(), old=old, new=np.array([u.find(int(x)) for x in old], np.int64))

    def rows(b):
        for r in b.to_pylist():
            old, new = (np.frombuffer(r[c] or b"", np.int64) for c in ("old", "new"))
            reps, labs, pivots, plabs = (np.frombuffer(r[c], np.int64) for c in ("reps", "labs", "pivots", "plabs"))
            yield r, reps, _named(labs, old, new), pivots, _named(plabs, old, new), np.frombuffer(r["d"], np.float32).reshape(len(reps), -1)

    def nearest_outsider(batches):
        for b in batches:
            for r, reps, labs, pivots, plabs, d in rows(b):
                out = np.where((labs[:, None] != plabs[None, :]) & ~np.isin(reps, pivots)[:, None], d, np.inf).min(0)
                yield from _one(b, r["cell"], far=out.astype(np.float32)).to_batches()

    def least(t: pa.Table) -> pa.Table:
        return _one(t, t.column("cell")[0].as_py(), far=np.min([np.frombuffer(x, np.float32) for x in t.column("far").to_pylist()], 0))

    def stay(batches):
        for b in batches:
            for r, reps, labs, pivots, plabs, d in rows(b):
                own = labs[:, None] == plabs[None, :]
                gone = (own & (d < np.frombuffer(r["far"], np.float32)[None, :] - RADIUS - 1e-5)).any(1) | np.isin(reps, pivots)
                reps, labs, d = reps[~gone], labs[~gone], d[~gone]
                if not len(reps):
                    continue
                near = d <= d.min(1, keepdims=True) + 2 * RADIUS + 1e-5
                sizes = near.sum(0).astype(float)  # groups are drawn by a hash: each tells the same
                many = sizes.sum() > REPLICATES * len(reps) or (sizes * sizes).sum() > PAIRS * len(reps) ** 2
                cells = (np.uint64(0x9E3779B97F4A7C15) * (np.uint64(r["cell"] & (1 << 64) - 1) ^ mix(pivots.astype(U64)))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["cell"]] * len(reps), pa.int64()), pa.array(reps), pa.array(labs), pa.array([r["width"]] * len(reps), pa.int32()), pa.array([None if many else cells[x].tolist() for x in near], pa.list_(pa.int64()))], names=["cell", "rep", "lab", "width", "cells"])

    blob = "cell long, old binary, new binary"
    names = seen.where(F.octet_length("merged") > 0).select("cell", "merged").groupBy("cell").applyInArrow(unite, blob)
    seen = salted_lookup(seen.select("cell", "salt", "width", "reps", "labs", "pivots", "plabs", "d"), ["cell"], "salt", materialize(names, "jaccard-names"))
    far = seen.mapInArrow(nearest_outsider, "cell long, far binary").groupBy("cell").applyInArrow(least, "cell long, far binary")
    seen = salted_lookup(seen, ["cell"], "salt", materialize(far, "jaccard-far"))
    left = materialize(seen.mapInArrow(stay, _MEMBERS + ", cells array<long>"), "jaccard-stay")
    # A cell is done when one component is left, and split when all of its groups can be.
    whole = left.groupBy("cell").agg((F.min("lab") < F.max("lab")).alias("open"), F.max(F.col("cells").isNull()).alias("whole"))
    return salted_lookup(left, ["cell"], "rep", whole).where("open").select("cell", "rep", "lab", "width", F.when(~F.col("whole"), F.col("cells")).alias("cells"))


def recount(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Cells that windows don't split (cell, rep, lab, width), by n-grams that their own
    members share: members that can have a partner, in the cells of their rarest
    n-grams or, where these replicate too much, in their cell with more pivots."""

    def explode(batches):
        for b in batches:
            for cell, rep, lab, width, n, s in zip(*(b.column(c).to_pylist() for c in ("cell", "rep", "lab", "width", "n", "set")), strict=True):
                t = np.frombuffer(s, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(t), x, np.int64)) for x in (cell, rep, lab, n)), pa.array(np.full(len(t), width, np.int32)), pa.array(t)], names=["cell", "rep", "lab", "n", "width", "tok"])

    toks = members.join(sets.select("rep", "n", "set"), "rep").mapInArrow(explode, "cell long, rep long, lab long, n long, width int, tok long")
    toks = materialize(toks, "jaccard-tokens")
    df = toks.groupBy("cell", "tok").agg(F.count("*").alias("df")).where("df > 1")
    known = salted_lookup(toks, ["cell", "tok"], "rep", df).where("df is not null")
    lists = known.groupBy("cell", "rep", "lab", "n", "width").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("known"))
    spare = F.size("known") - F.ceil(F.col("n") * PERCENT / 100).cast("int")
    able = materialize(lists.where(spare >= 0).select("cell", "rep", "lab", "width", F.transform(F.slice("known", 1, spare + 1), lambda x: x["tok"]).alias("toks")), "jaccard-able")
    parts = able.select("cell", F.explode("toks").alias("tok")).groupBy("cell", "tok").agg(F.count("*").cast("double").alias("c"))
    sums = parts.groupBy("cell").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("c2")).join(able.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    split = (F.col("c") <= REPLICATES * F.col("m")) & (F.col("c2") <= PAIRS * F.col("m") * F.col("m"))
    both = salted_lookup(able, ["cell"], "rep", sums.select("cell", split.alias("split")))
    split = both.where("split").select(F.explode("toks").alias("tok"), "cell", "rep", "lab", "width").withColumn("cell", F.xxhash64("cell", "tok")).drop("tok")
    return split.union(both.where("not split").select("cell", "rep", "lab", "width")).withColumn("width", F.col("width") * 4)


def _prio(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("rep"))


def link_cells(members: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Links of cells of any size; `members`: cell, rep, lab (name of the component that
    rep is known to be in: itself, if of none)."""
    links, level = [], 0
    members = members.select("cell", "rep", "lab", F.lit(PIVOTS).alias("width"))
    while True:
        weighed = members.join(sets.select("rep", "n"), "rep").select("cell", "rep", "lab", "width", "n")
        sizes = weighed.groupBy("cell").agg(F.count("*").alias("size"), F.sum("n").alias("total"), (F.min("lab") < F.max("lab")).alias("open"))
        sized = materialize(salted_lookup(weighed, ["cell"], "rep", sizes.where("open").drop("open")).where("size is not null"), "jaccard-cells")
        small = f"size <= {CELL} and total <= {2 * TOKENS} or size = 2"
        links.append(materialize(join_cells(sized.where(small), sets), "jaccard-links"))
        large = sized.where(f"not ({small})")
        if large.isEmpty():
            return links
        seen = measure(large, sets, level)
        links.append(seen.select("links").mapInArrow(_unpacked, "u long, v long"))
        left = materialize(split_cells(seen), "jaccard-left")
        rest = left.where("cells is null").select("cell", "rep", "lab", "width")
        # n-grams are counted while a cell has the first number of pivots, then that grows.
        first, again = rest.where(f"width <= {PIVOTS}"), rest.where(f"width > {PIVOTS}").withColumn("width", F.least(F.col("width") * 4, F.lit(MOST_PIVOTS)))
        members = left.where("cells is not null").select(F.explode("cells").alias("cell"), "rep", "lab", "width").union(again)
        if not first.isEmpty():
            members = members.union(recount(first, sets))
        members, level = materialize(members.distinct(), "jaccard-members"), level + 1


def _unpacked(batches):
    for b in batches:
        at = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 2) for x in b.column("links").to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["u", "v"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_shingles, component_id, th
    (hash of the text) and component, which names the component itself (two of them have
    one component_id where a doc_id has several texts); null without doc_id or words."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    stats = materialize(statistics(docs), "jaccard-stats")
    one = stats.where("doc_id is not null and n > 0").select("doc_id", "h1", "h2", "n").distinct()
    # A node is a doc_id, or a hash where one has several sets.
    several = materialize(one.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several")), "jaccard-several")
    repeated = not several.isEmpty()
    node = F.when(F.col("several"), F.xxhash64("doc_id", "h1", "h2")).otherwise(F.col("doc_id")) if repeated else F.col("doc_id")
    one = (salted_lookup(one, ["doc_id"], "h1", several) if repeated else one).select("doc_id", "h1", "h2", "n", node.alias("node"))
    same = one.groupBy("h1", "h2", "n").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep < last").drop("last")
    classes = salted_lookup(one, ["h1", "h2", "n"], "doc_id", same).select("doc_id", F.coalesce("rep", "node").alias("rep"), "node", "h1", "h2", "n")
    classes = materialize(classes, "jaccard-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(default_partitions(spark), -(-int(total) // (3 * BUCKET)))

    known, used = known_elsewhere(docs.where("doc_id is not null"), buckets)
    least = lambda n: F.ceil(n * PERCENT / 100)
    extra = lambda n: F.greatest(F.lit(1), F.floor(n / 10))
    n = F.col("n")
    wanted = materialize(classes.where("node = rep").join(known, "doc_id").where(F.col("known") >= F.least(extra(n), extra(least(n)))).select("doc_id", "h1", "rep"), "jaccard-wanted")
    for t in used:
        drop_table(t)
    if wanted.count() * 24 <= 32 << 20:
        wanted = F.broadcast(wanted)
    chunks = materialize(whole_sets(docs, wanted), "jaccard-sets")
    sets = materialize(regions(chunks, buckets), "jaccard-regions")
    drop_table(chunks)

    flat = sets.select("rep", F.explode("regions").alias("region"))
    pivots = flat.groupBy("region").agg(F.min(_prio("rep")).alias("p"), F.count("*").alias("k")).where("k > 1").select("region", F.col("p.rep").alias("cell"))
    cells = materialize(salted_lookup(flat, ["region"], "rep", pivots).where("cell is not null").select("cell", "rep").distinct(), "jaccard-members")
    home = cells.groupBy("rep").agg(F.min(_prio("cell")).alias("p")).select(F.col("p.rep").alias("cell"), "rep")
    links = link_cells(_with_pivot(home).withColumn("lab", F.col("rep")), sets)
    found = components(_union(links))
    lookup = materialize(found, "jaccard-found")
    marked = cells.join(lookup, cells["rep"] == lookup["node"], "left").select("cell", "rep", F.coalesce("component", "rep").alias("c"))
    open_ = marked.groupBy("cell").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("cell")
    rest = materialize(salted_lookup(marked, ["cell"], "rep", open_.withColumn("open", F.lit(True))).where("open").select("cell", "rep", F.col("c").alias("lab")), "jaccard-open")
    if not rest.isEmpty():
        links += link_cells(rest, sets)
        lookup = materialize(components(_union(links)), "jaccard-found")

    joined = salted_lookup(classes, ["rep"], "doc_id", lookup.select(F.col("node").alias("rep"), "component"))
    joined = joined.select("doc_id", "h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    least_id = F.col("component")
    if repeated:  # a component's name may be a hash then
        joined = materialize(joined, "jaccard-named")
        joined = salted_lookup(joined, ["component"], "doc_id", joined.groupBy("component").agg(F.min("doc_id").alias("least")))
        least_id = F.col("least")
    done = stats.join(joined, ["doc_id", "h1", "h2", "n"], "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(least_id, "doc_id").alias("component_id"), "th", "component")


def _with_pivot(home: DataFrame) -> DataFrame:
    """A cell's pivot is a member of it, whatever its own home is."""
    return home.union(home.select("cell", F.col("cell").alias("rep"))).distinct()


def _union(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).drop("th", "component")


QUERIES = {"op3_jaccard": op3_jaccard}
ORACLE: dict[str, str] = {}
