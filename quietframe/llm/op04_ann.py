"""Approximate nearest neighbours by NN-descent, queried by greedy graph search.

Equal vectors are one node.  Nodes lie in parts of at most PART, in the order of random
projections; a node's number is its part and its place there, and all joins are between
parts: what a part needs of another one is asked for and answered in packed arrays.

A first graph comes from exact joins of leaves of TREES trees of random projections.
Then each round of NN-descent joins the graph with itself: a node's neighbours, and the
nodes that have it as neighbour, meet at the node and are told of each other where that
is nearer than what they have.  Of two that meet one at least is new there.  Rounds end
when one changes at most a share SETTLED of all neighbours, however many it takes.

A query starts at its own node's neighbours and expands the nearest ones not yet
expanded, until all of its `beam` nearest are, so that they stay the same.  Then recall
is measured: SAMPLE of the queries are held against all nodes, exactly; while their
recall is below TARGET, the graph gets another round, the beam is doubled and the SAMPLE
searches again, up to a beam of all nodes; with the beam that reaches it all queries do.
Answers are scored anew in double precision on the original vectors.

Bounds: directions are centred by CENTRE vectors, chosen by a hash of vec_id; MEET, LEAF
and NEIGHBOURS bound what is compared in a round, never what takes part.

Contract for odd rows: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null vec_ids, nor vectors of another length than the
most frequent; of rows that share a vec_id the least vector counts; equal vectors are
ranked by vec_id; extra columns are not read; an empty table gives none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import default_partitions, drop_table, materialize, pick, prepare, read_table, salted_lookup
from .kernels import U64, mix

TOP, EVERY = 20, 20
#: Neighbours in the graph; vectors in a leaf; trees.
NEIGHBOURS, LEAF, TREES = 48, 2048, 8
#: Nodes in a part at most, and parts at least while they have SMALL nodes.
SHIFT, PARTS, SMALL = 12, 24, 256
CENTRE = 2048
#: Share of changed neighbours at which the graph is settled.
SETTLED = 0.1
#: New, and old, neighbours either way that meet at a node.
MEET = 12
#: Answers that a search keeps, and nodes that it expands in a round.
BEAM, EXPAND = 128, 64
#: Answers that are scored in double precision.
FINAL = 48
#: Queries whose recall is measured, and what it must reach.
SAMPLE, TARGET = 128, 0.95

_LOCAL = (1 << SHIFT) - 1
_NODES = "part long, own binary, vec binary, asked binary"
_STATE = _NODES + ", ids binary, sims binary, fresh binary, changed long"
_SEARCH = "part long, q binary, qid binary, qvec binary, ids binary, sims binary, done binary, todo long"
_I64, _I32, _F32, _BIN, _U8 = np.int64, np.int32, np.float32, pa.binary(), np.uint8


def _encoded(x: np.ndarray) -> np.ndarray:
    """Floats as bytes that stand in the floats' order; both zeros are one."""
    u = np.dtype(f"u{x.dtype.itemsize}")
    top = u.type(1 << (8 * u.itemsize - 1))
    bits = (x + x.dtype.type(0)).view(u)
    return np.where(bits & top, ~bits, bits | top).astype(u.newbyteorder(">")).view(_U8)


def _decoded(raw: np.ndarray, kind: str) -> np.ndarray:
    u = np.dtype(f">u{np.dtype(kind).itemsize}")
    bits = raw.view(u).astype(u.newbyteorder("="))
    top = bits.dtype.type(1 << (8 * u.itemsize - 1))
    return np.where(bits & top, bits ^ top, ~bits).view(kind)


def vectors(table: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, key) of the rows that take part, and what floats a key encodes."""
    prepare(table.sparkSession)
    t = pick(table, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    kind = "f4" if t.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    t = t.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>"))

    def keep(batches):
        for b in batches:
            if b.num_rows:
                lists = b.column("embedding")
                x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                odd, some = (np.concatenate([[0], np.cumsum(m)])[ends] for m in (~np.isfinite(x), x != 0))
                ok = pa.array((np.diff(odd) == 0) & (np.diff(some) > 0))
                keys = pa.Array.from_buffers(_BIN, len(lists), [None, pa.py_buffer((ends * x.itemsize).astype(_I32)), pa.py_buffer(_encoded(x))])
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in (b.column("vec_id"), pa.array(np.diff(ends).astype(_I32)), keys)], names=["vec_id", "d", "key"])

    t = materialize(t.mapInArrow(keep, "vec_id long, d int, key binary"), "ann-input")
    sizes = t.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    out = materialize(t.where(F.col("d") == (sizes[0]["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("key").alias("key")), "ann-vectors")
    drop_table(t)
    return out, kind


# packed arrays


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows of longs, ints and arrays (as binary) under a DDL schema of long, int and binary."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "binary": _BIN}
    cols = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.table({n: pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], types[k]) for n, k, c in zip(names, kinds, cols, strict=True)})


def _all(t: pa.Table, name: str, dtype) -> np.ndarray:
    """A binary column's arrays, one after the other."""
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype)


def _flat(col: pa.Array, dtype) -> np.ndarray:
    """A binary column's arrays, one after the other, without a copy."""
    _, off, data = col.buffers()
    at = np.frombuffer(off, _I32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, _U8)[at[0] : at[-1]].view(dtype) if len(col) else np.zeros(0, dtype)


def _binary(m: np.ndarray) -> pa.Array:
    """A binary column of the rows of `m`."""
    at = np.arange(len(m) + 1, dtype=_I32) * _I32(m.shape[1] * m.itemsize)
    return pa.Array.from_buffers(_BIN, len(m), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(m))])


def _records(t, *names: str) -> Iterator[tuple]:
    return zip(*(t.column(n).to_pylist() for n in names), strict=True)


def _map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.Table]], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                for t in f(b):
                    yield from t.to_batches()

    return df.mapInArrow(run, schema)


def _join(a: DataFrame, b: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return a.groupBy("part").cogroup(b.groupBy("part")).applyInArrow(f, schema)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Place in its run of equal keys."""
    n, s = len(keys[0]), _starts(*keys)
    return np.arange(n) - np.repeat(s, np.diff(np.append(s, n)))


def _by_part(gids: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Parts of ascending node numbers, and where they stand."""
    p = gids >> SHIFT
    at = [*_starts(p).tolist(), len(p)]
    for x, y in zip(at, at[1:]):
        yield int(p[x]), slice(x, y)


def _pairs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int, int, int] | None:
    """One number for each pair, in the order of (u, v), the bits of v in it, and what was
    taken off u and v; None where 62 bits don't hold it.  One key sorts far faster than two."""
    if not len(u):
        return np.zeros(0, _I64), 0, 0, 0
    a, b = int(u.min()), int(v.min())
    bits = (int(v.max()) - b).bit_length()
    if (int(u.max()) - a).bit_length() + bits > 62:
        return None
    return (u.astype(_I64) - a) << bits | (v.astype(_I64) - b), bits, a, b


def _once(u: np.ndarray, v: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Places of each pair (u, v) once, in order; of equal ones that with the least `late` (0 or 1)."""
    if (p := _pairs(u, v)) is None:
        o = np.lexsort((late, v, u))
        return o[_starts(u[o], v[o])]
    key = p[0] << 1 | late
    o = np.argsort(key)
    return o[_starts(key[o] >> 1)]


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (u, v) once, in order."""
    if (p := _pairs(u, v)) is None:
        o = _once(u, v, np.zeros(len(u), _U8))
        return u[o], v[o]
    key, bits, a, b = p
    key = np.sort(key)
    key = key[_starts(key)]
    return (key >> bits) + a, (key & ((1 << bits) - 1)) + b


def _unseen(u: np.ndarray, v: np.ndarray, seen_u: np.ndarray, seen_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (u, v) once that is none of the seen ones, by v, then u."""
    late = np.concatenate([np.zeros(len(seen_u), _I64), np.ones(len(u), _I64)])
    u, v = np.concatenate([seen_u, u]), np.concatenate([seen_v, v])
    if (p := _pairs(v, u)) is None:
        o = _once(v, u, late)
        o = o[late[o] == 1]
        return u[o], v[o]
    key, bits, a, b = p
    key = np.sort(key << 1 | late)
    key = key[_starts(key >> 1)]
    key = key[key & 1 == 1] >> 1
    return (key & ((1 << bits) - 1)) + b, (key >> bits) + a


def _nearest(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k of greatest s of each u (least v first), by u, and their ranks."""
    if not len(u) or s.dtype != _F32 or int(u.max()) - int(u.min()) >= 1 << 31:
        o = np.lexsort((v, -s, u))
    else:
        bits = (s + _F32(0)).view(np.uint32)
        falling = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))
        key = (u.astype(_I64) - int(u.min())) << 32 | falling
        o = np.argsort(key)
        key = key[o]
        same = key[1:] == key[:-1]
        if same.any():
            at = np.flatnonzero(np.append(same, False) | np.append(False, same))
            o[at] = o[at][np.lexsort((v[o[at]], key[at]))]
    r = _rank(u[o])
    keep = r < k
    return o[keep], r[keep]


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k greatest of each row and their values, greatest first.  Of so many
    groups of columns the k-th greatest maximum is reached by k values at least: the others go."""
    w = max(1, s.shape[1] // (4 * k))
    g = s.shape[1] // w
    most = s[:, : g * w].reshape(len(s), w, g).max(1)
    if np.isnan(most).any():
        return _top(np.where(np.isnan(s), _F32(-np.inf), s), k)
    bar = np.partition(most, g - k, axis=1)[:, g - k]
    at = np.flatnonzero(s >= bar[:, None])
    row, col = np.divmod(at, s.shape[1])
    val = s.ravel()[at]
    o, _ = _nearest(row, col, val, k)
    return col[o].reshape(-1, k), val[o].reshape(-1, k)


def _lists(n: int, k: int, u: np.ndarray, v: np.ndarray, s: np.ndarray, flag: np.ndarray, late: np.ndarray):
    """n lists of the k nearest: ids (-1 where there are fewer), sims, flags, and how many are `late`."""
    o = _once(u, v, late)
    ids, sims, flags, kept = _filled(n, k, u[o], v[o], s[o], flag[o])
    return ids, sims, flags, int(late[o][kept].sum())


def _filled(n: int, k: int, u: np.ndarray, v: np.ndarray, s: np.ndarray, flag: np.ndarray):
    """n lists of the k nearest of pairs that are there once, and the places of what they hold."""
    o, r = _nearest(u, v, s, k)
    ids, sims, flags = np.full((n, k), -1, _I64), np.full((n, k), -np.inf, _F32), np.zeros((n, k), _U8)
    ids[u[o], r], sims[u[o], r], flags[u[o], r] = v[o], s[o], flag[o]
    return ids, sims, flags, o


# nodes and the first graph


def _axes(dim: int, levels: int, tree: int) -> np.ndarray:
    a = np.random.default_rng(17 + tree).normal(size=(dim, levels + 1))
    return (np.linalg.qr(a)[0] if levels < dim else a).astype(_F32)


def _code(vec: np.ndarray, centre: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The side of the centre on each axis but the last as bits, and the place on the last."""
    p = (vec - centre) @ axes
    return (p[:, :-1] > 0) @ (1 << np.arange(axes.shape[1] - 2, -1, -1, dtype=_I64)), p[:, -1]


def _levels(size: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, size) / LEAF))))


def nodes(distinct: DataFrame, size: int, dim: int, kind: str) -> DataFrame:
    """Parts of nodes: the least vec_id of each different vector, the vector as 4-byte
    floats, and whether it is asked for."""
    chosen = distinct.orderBy(F.xxhash64("id"), "id").limit(CENTRE).select("key").collect()  # a bounded sample
    centre = np.mean([_decoded(np.frombuffer(r[0], _U8), kind) for r in chosen], 0, dtype=float).astype(_F32)
    axes = _axes(dim, _levels(size) + 4, 0)
    per = min(1 << SHIFT, max(SMALL, -(-size // PARTS)))
    n = max(1, min(default_partitions(distinct.sparkSession), size // per) if size < per * 4096 else size // (16 * per))

    def project(batches):
        for b in batches:
            if b.num_rows:
                flat = _decoded(_flat(b.column("key"), _U8), kind).astype(_F32).reshape(b.num_rows, -1)
                code, p = _code(flat, centre, axes)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("asked"), _binary(flat), pa.array(code), pa.array(p)], names=["id", "asked", "vec", "code", "p"])

    def cut(batches):
        from pyspark import TaskContext

        first, k = TaskContext.get().partitionId() << 20, 0
        ids, vecs_, asked = [], [], []
        for b in batches:
            for i, v, a in _records(b, "id", "vec", "asked"):
                ids.append(i)
                vecs_.append(v)
                asked.append(a)
                if len(ids) == per:
                    yield from _table(_NODES, [(first + k, np.array(ids, _I64), b"".join(vecs_), np.array(asked, _U8))]).to_batches()
                    ids, vecs_, asked, k = [], [], [], k + 1
        if ids:
            yield from _table(_NODES, [(first + k, np.array(ids, _I64), b"".join(vecs_), np.array(asked, _U8))]).to_batches()

    rows = distinct.select("id", "asked", "key").mapInArrow(project, "id long, asked int, vec binary, code long, p float")
    parts = rows.repartitionByRange(n, "code", "p", "id").sortWithinPartitions("code", "p", "id").select("id", "asked", "vec").mapInArrow(cut, _NODES)
    return materialize(parts, "ann-nodes")


def first_graph(table: DataFrame, dim: int, size: int, k: int = NEIGHBOURS) -> DataFrame:
    """State of the parts in `table`: lists from the leaves of TREES trees."""
    levels, trees = _levels(size), TREES
    spark = table.sparkSession
    centre = _centre(table, dim)
    blocks = size * trees // LEAF
    n = max(1, min(max(default_partitions(spark), blocks // 16), blocks))

    def project(b):
        for part, vec in _records(b, "part", "vec"):
            m = np.frombuffer(vec, _F32).reshape(-1, dim)
            gid, raw = part << SHIFT | np.arange(len(m)), _binary(m)
            for t in range(trees):
                code, p = _code(m, centre, _axes(dim, levels, t))
                yield pa.table({"tree": pa.array(np.full(len(m), t, _I32)), "code": pa.array(code), "p": pa.array(p), "gid": pa.array(gid), "vec": raw})

    def leaf(gid: np.ndarray, m: np.ndarray) -> pa.Table:
        o = np.argsort(gid)
        gid, m = gid[o], m[o]
        kk = min(k, len(gid) - 1)
        ids, sims = np.full((len(gid), k), -1, _I64), np.full((len(gid), k), -np.inf, _F32)
        for x in range(0, len(gid) if kk > 0 else 0, 512):
            s = m[x : x + 512] @ m.T
            i = np.arange(len(s))
            s[i, x + i] = -np.inf
            near, far = _top(s, kk)
            ids[x : x + len(s), :kk], sims[x : x + len(s), :kk] = gid[near], far
        return _table("part long, u binary, ids binary, sims binary", [(p, (gid[at] & _LOCAL).astype(_I32), ids[at], sims[at]) for p, at in _by_part(gid)])

    def leaves(batches):
        tree, held, gids, vecs = -1, 0, [], []

        def flush():
            return leaf(np.concatenate(gids), np.concatenate(vecs)).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t, g, v = b.column("tree").to_numpy(), b.column("gid").to_numpy(), _flat(b.column("vec"), _F32).reshape(-1, dim)
            at = [*_starts(t).tolist(), len(t)]
            for x, end in zip(at, at[1:]):
                while x < end:
                    if held and (t[x] != tree or held == LEAF):
                        yield from flush()
                        held, gids, vecs = 0, [], []
                    tree, y = t[x], min(end, x + LEAF - held)
                    gids.append(g[x:y])
                    vecs.append(v[x:y])
                    held, x = held + y - x, y
        if held:
            yield from flush()

    def start(t: pa.Table, lists: pa.Table) -> pa.Table:
        m = len(t.column("own")[0].as_py()) // 8
        u = np.repeat(_all(lists, "u", _I32).astype(_I64), k)
        v, s = _all(lists, "ids", _I64), _all(lists, "sims", _F32)
        ok = v >= 0
        zero = np.zeros(int(ok.sum()), _U8)
        ids, sims, _, _ = _lists(m, k, u[ok], v[ok], s[ok], zero, zero)
        part, own, vec, asked = next(_records(t, "part", "own", "vec", "asked"))
        return _table(_STATE, [(part, own, vec, asked, ids, sims, (ids >= 0).astype(_U8), m * k)])

    rows = _map(table.select("part", "vec"), project, "tree int, code long, p float, gid long, vec binary")
    order = ("tree", "code", "p", "gid")
    lists = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(leaves, "part long, u binary, ids binary, sims binary")
    return materialize(_join(table, lists, start, _STATE), "ann-graph")


def _centre(table: DataFrame, dim: int) -> np.ndarray:
    """Mean of the first vectors of CENTRE parts, by a hash of the part."""
    got = table.orderBy(F.xxhash64("part"), "part").limit(CENTRE).select(F.substring("vec", 1, 4 * dim * 16).alias("v")).collect()
    return np.concatenate([np.frombuffer(r[0], _F32).reshape(-1, dim) for r in got]).mean(0)


# rounds


def _draws(u: np.ndarray, v: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(u.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) ^ v.astype(U64))


def _chosen(part: int, ids: np.ndarray, fresh: np.ndarray, seed: int, meet: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the new and of the old neighbours that a node brings to its own meeting."""
    gid = part << SHIFT | np.arange(len(ids))
    draw = _draws(np.repeat(gid, ids.shape[1]), ids.ravel(), seed).reshape(ids.shape) >> U64(1)
    out = []
    for want in (1, 0):
        d = np.where((ids >= 0) & (fresh == want), draw, U64(1 << 63))
        at = np.argsort(d, axis=1)[:, :meet]
        mask = np.zeros(ids.shape, bool)
        np.put_along_axis(mask, at, np.take_along_axis(d, at, 1) < U64(1 << 63), 1)
        out.append(mask)
    return out[0], out[1]


def _limited(at: np.ndarray, who: np.ndarray, new: np.ndarray, draw: np.ndarray, meet: int) -> np.ndarray:
    """Places, by `at`, of at most `meet` new and as many old ones for each."""
    if (p := _pairs(at, new)) is None:
        o = np.lexsort((draw, new, at))
        return o[_rank(at[o], new[o]) < meet]
    key = p[0]
    o = np.argsort(key)
    r, n = _rank(key[o]), np.diff(np.append(_starts(key[o]), len(o)))
    over = np.repeat(n > meet, n)  # only there draws tell
    if over.any():
        o[over] = o[over][np.lexsort((draw[o[over]], key[o[over]]))]
    return o[r < meet]


def descend(state: DataFrame, dim: int, seed: int, k: int = NEIGHBOURS, meet: int = MEET) -> DataFrame:
    """One round: what nodes had and the news of all meetings."""

    def tell(b):
        """Neighbours are told who has them; a part sends at most `meet` of a kind for each."""
        rows = []
        for part, ids, fresh in _records(b, "part", "ids", "fresh"):
            ids = np.frombuffer(ids, _I64).reshape(-1, k)
            fresh = np.frombuffer(fresh, _U8).reshape(-1, k)
            ok = ids >= 0
            u, v, f = np.nonzero(ok)[0] + (part << SHIFT), ids[ok], fresh[ok]
            o = _limited(v, u, f, _draws(u, v, seed), meet)
            u, v, f = u[o], v[o], f[o]
            rows += [(p, (v[at] & _LOCAL).astype(_I32), u[at], f[at]) for p, at in _by_part(v)]
        yield _table("part long, at binary, who binary, new binary", rows)

    def meet_(t: pa.Table, told: pa.Table) -> pa.Table:
        part, ids, fresh = next(_records(t, "part", "ids", "fresh"))
        ids = np.frombuffer(ids, _I64).reshape(-1, k)
        new, old = _chosen(part, ids, np.frombuffer(fresh, _U8).reshape(-1, k), seed, meet)
        at, who, f = _all(told, "at", _I32).astype(_I64), _all(told, "who", _I64), _all(told, "new", _U8)
        o = _limited(at, who, f, _draws(who, at + (part << SHIFT), seed), meet)
        at = np.concatenate([at[o], np.nonzero(new)[0], np.nonzero(old)[0]])
        who = np.concatenate([who[o], ids[new], ids[old]])
        f = np.concatenate([f[o], np.ones(int(new.sum()), _U8), np.zeros(int(old.sum()), _U8)])
        o = _once(at, who, 1 - f)
        at, who, f = at[o], who[o], f[o]
        some = np.bincount(at, f, minlength=len(ids))[at] > 0
        return _table("part long, at binary, who binary, new binary", [(part, at[some].astype(_I32), who[some], f[some])])

    def ask(b):
        rows = []
        for part, who in _records(b, "part", "who"):
            w = np.unique(np.frombuffer(who, _I64))
            rows += [(p, part, w[at]) for p, at in _by_part(w)]
        yield _table("part long, back long, who binary", rows)

    def serve(t: pa.Table, asks: pa.Table) -> pa.Table:
        vec, sims = next(_records(t, "vec", "sims"))
        vec, worst = np.frombuffer(vec, _F32).reshape(-1, dim), np.frombuffer(sims, _F32).reshape(-1, k)[:, -1]
        rows = []
        for back, who in _records(asks, "back", "who"):
            at = np.frombuffer(who, _I64) & _LOCAL
            rows.append((back, who, vec[at], worst[at]))
        return _table("part long, who binary, vec binary, worst binary", rows)

    def news(met: pa.Table, served: pa.Table) -> pa.Table:
        out = "part long, u binary, v binary, s binary"
        if not met.num_rows or not served.num_rows:
            return _table(out, [])
        at, who, new = _all(met, "at", _I32), _all(met, "who", _I64), _all(met, "new", _U8).astype(bool)
        w, vec = _all(served, "who", _I64), _all(served, "vec", _F32).reshape(-1, dim)
        order = np.argsort(w)
        w, worst = w[order], np.append(_all(served, "worst", _F32)[order], np.float32(np.inf))
        vec, place = np.concatenate([vec[order], np.zeros((1, dim), _F32)]), np.searchsorted(w, who)
        s, r = _starts(at), _rank(at)
        row = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(at))))
        got = []
        for x in range(0, len(s), 256):  # so many meetings at a time, all padded to one size
            here = slice(int(s[x]), int(s[x + 256]) if x + 256 < len(s) else len(at))
            size = int(r[here].max()) + 1
            idx, fresh = np.full((min(256, len(s) - x), size), len(w)), np.zeros((min(256, len(s) - x), size), bool)
            idx[row[here] - x, r[here]], fresh[row[here] - x, r[here]] = place[here], new[here]
            v = vec[idx]
            sim = v @ v.transpose(0, 2, 1)
            bar = worst[idx]
            ok = (sim > np.minimum(bar[:, :, None], bar[:, None, :])) & (fresh[:, :, None] | fresh[:, None, :]) & np.triu(np.ones((size, size), bool), 1)
            m, i, j = np.nonzero(ok & (idx < len(w))[:, :, None] & (idx < len(w))[:, None, :])
            a, b_, c = idx[m, i], idx[m, j], sim[m, i, j]
            for x_, y_ in ((a, b_), (b_, a)):
                near = c > worst[x_]
                got.append((x_[near], y_[near], c[near]))
        u, v, c = (np.concatenate(z) for z in zip(*got, strict=True)) if got else (np.zeros(0, _I64), np.zeros(0, _I64), np.zeros(0, _F32))
        o = _once(u, v, np.zeros(len(u), _U8))
        u, v, c = u[o], v[o], c[o]
        o, _ = _nearest(u, v, c, k)
        u, v, c = w[u[o]], w[v[o]], c[o]
        return _table(out, [(p, (u[at_] & _LOCAL).astype(_I32), v[at_], c[at_].astype(_F32)) for p, at_ in _by_part(u)])

    def merge(t: pa.Table, told: pa.Table) -> pa.Table:
        part, own, vec, asked, ids, sims, fresh = next(_records(t, "part", "own", "vec", "asked", "ids", "sims", "fresh"))
        ids, sims, fresh = (np.frombuffer(x, d).reshape(-1, k) for x, d in ((ids, _I64), (sims, _F32), (fresh, _U8)))
        met, _ = _chosen(part, ids, fresh, seed, meet)
        ok = ids >= 0
        u, v, s = _all(told, "u", _I32).astype(_I64), _all(told, "v", _I64), _all(told, "s", _F32)
        flag = np.concatenate([np.where(met, 0, fresh)[ok], np.ones(len(u), _U8)]).astype(_U8)
        late = np.concatenate([np.zeros(int(ok.sum()), _U8), np.ones(len(u), _U8)])
        got = _lists(len(ids), k, np.concatenate([np.nonzero(ok)[0], u]), np.concatenate([ids[ok], v]), np.concatenate([sims[ok], s]), flag, late)
        return _table(_STATE, [(part, own, vec, asked, *got)])

    told = _map(state.select("part", "ids", "fresh"), tell, "part long, at binary, who binary, new binary")
    met = materialize(_join(state.select("part", "ids", "fresh"), told, meet_, "part long, at binary, who binary, new binary"), "ann-met")
    asks = _map(met.select("part", "who"), ask, "part long, back long, who binary")
    served = _join(state.select("part", "vec", "sims"), asks, serve, "part long, who binary, vec binary, worst binary")
    told = _join(met, served, news, "part long, u binary, v binary, s binary")
    out = materialize(_join(state, told, merge, _STATE), "ann-graph")
    drop_table(met)
    return out


def changed(state: DataFrame, size: int, k: int = NEIGHBOURS) -> float:
    """Share of the neighbours that the last round brought."""
    return (state.agg(F.sum("changed")).first()[0] or 0) / max(1, size * min(k, size - 1))


def neighbour_graph(table: DataFrame, dim: int, size: int) -> DataFrame:
    """Rounds until the graph is settled; lists only get nearer, so it comes to that.  The
    first round's share is left out: half of what it could bring has not met yet."""
    state, r = first_graph(table, dim, size), 0
    while True:
        before, state = state, descend(state, dim, r)
        drop_table(before)
        share = changed(state, size)
        r += 1
        if share == 0 or (r > 1 and share <= SETTLED):
            return state


# search


def _frontier(ids: np.ndarray, done: np.ndarray) -> np.ndarray:
    """Mask of the nodes that searches expand next."""
    open_ = (ids >= 0) & (done == 0)
    return open_ & (np.cumsum(open_, axis=1) <= EXPAND)


def begin(state: DataFrame, dim: int, beam: int, k: int = NEIGHBOURS) -> DataFrame:
    """Searches of the nodes that are asked for, in the parts of the nodes."""

    def run(b):
        rows = []
        for part, own, vec, asked, ids, sims in _records(b, "part", "own", "vec", "asked", "ids", "sims"):
            at = np.flatnonzero(np.frombuffer(asked, _U8))
            if len(at):
                ids, sims = np.frombuffer(ids, _I64).reshape(-1, k)[at], np.frombuffer(sims, _F32).reshape(-1, k)[at]
                wide, far = np.full((len(at), beam), -1, _I64), np.full((len(at), beam), -np.inf, _F32)
                wide[:, :k], far[:, :k] = ids[:, :beam], sims[:, :beam]
                rows.append((part, at + (part << SHIFT), np.frombuffer(own, _I64)[at], np.frombuffer(vec, _F32).reshape(-1, dim)[at], wide, far, np.zeros(wide.shape, _U8), int((wide >= 0).sum())))
        yield _table(_SEARCH, rows)

    return materialize(_map(state.select("part", "own", "vec", "asked", "ids", "sims"), run, _SEARCH), "ann-search")


def step(found: DataFrame, state: DataFrame, dim: int, beam: int, k: int = NEIGHBOURS) -> DataFrame:
    """All searches expand their frontier."""
    pairs = "part long, qi binary, c binary"

    def ask(b):
        rows = []
        for part, ids, done in _records(b, "part", "ids", "done"):
            ids = np.frombuffer(ids, _I64).reshape(-1, beam)
            mask = _frontier(ids, np.frombuffer(done, _U8).reshape(-1, beam))
            node, qi = _distinct(ids[mask], np.nonzero(mask)[0])
            qi = qi.astype(_I32)
            rows += [(p, part, qi[at], (node[at] & _LOCAL).astype(_I32)) for p, at in _by_part(node)]
        yield _table("part long, back long, qi binary, node binary", rows)

    def expand(t: pa.Table, asks: pa.Table) -> pa.Table:
        rows = []
        if asks.num_rows:
            lists = np.frombuffer(t.column("ids")[0].as_py(), _I64).reshape(-1, k)
            for back, qi, node in _records(asks, "back", "qi", "node"):
                c = lists[np.frombuffer(node, _I32)]
                qi = np.repeat(np.frombuffer(qi, _I32), k)[c.ravel() >= 0]
                qi, c = _distinct(qi, c[c >= 0])
                rows.append((back, qi.astype(_I32), c))
        return _table(pairs, rows)

    def gather(t: pa.Table, told: pa.Table) -> pa.Table:
        """New candidates of each search, its vector and what they must reach, to the candidates' parts."""
        out = "part long, back long, qi binary, c binary, uq binary, qvec binary, bar binary"
        if not told.num_rows:
            return _table(out, [])
        part, q, qvec, ids, sims = next(_records(t, "part", "q", "qvec", "ids", "sims"))
        q, qvec, ids = np.frombuffer(q, _I64), np.frombuffer(qvec, _F32).reshape(-1, dim), np.frombuffer(ids, _I64).reshape(-1, beam)
        bar, ok = np.frombuffer(sims, _F32).reshape(-1, beam)[:, -1], ids >= 0
        qi, c = _all(told, "qi", _I32).astype(_I64), _all(told, "c", _I64)
        qi, c = _unseen(qi, c, np.concatenate([np.nonzero(ok)[0], np.arange(len(q))]), np.concatenate([ids[ok], q]))
        rows = []
        for p, at in _by_part(c):
            here = np.zeros(len(q), _I64)
            here[qi[at]] = 1
            uq, place = np.flatnonzero(here), (np.cumsum(here) - 1)[qi[at]]
            rows.append((p, part, place.astype(_I32), (c[at] & _LOCAL).astype(_I32), uq.astype(_I32), qvec[uq], bar[uq]))
        return _table(out, rows)

    def score(t: pa.Table, asks: pa.Table) -> pa.Table:
        rows = []
        if asks.num_rows:
            part, vec = next(_records(t, "part", "vec"))
            vec = np.frombuffer(vec, _F32).reshape(-1, dim)
            for back, place, c, uq, qvec, bar in _records(asks, "back", "qi", "c", "uq", "qvec", "bar"):
                place, c, uq = np.frombuffer(place, _I32), np.frombuffer(c, _I32), np.frombuffer(uq, _I32)
                qvec = np.frombuffer(qvec, _F32).reshape(-1, dim)
                s = np.concatenate([np.einsum("ij,ij->i", qvec[place[x : x + 2048]], vec[c[x : x + 2048]]) for x in range(0, len(c), 2048)])
                o = np.flatnonzero(s >= np.frombuffer(bar, _F32)[place])
                if len(o) and np.bincount(place[o]).max() > beam:
                    o = o[_nearest(place[o], c[o], s[o], beam)[0]]
                rows.append((back, uq[place[o]], c[o].astype(_I64) + (part << SHIFT), s[o].astype(_F32)))
        return _table(pairs + ", s binary", rows)

    def absorb(t: pa.Table, told: pa.Table) -> pa.Table:
        part, q, qid, qvec, ids, sims, done = next(_records(t, "part", "q", "qid", "qvec", "ids", "sims", "done"))
        ids, sims, done = (np.frombuffer(x, d).reshape(-1, beam) for x, d in ((ids, _I64), (sims, _F32), (done, _U8)))
        done = np.where(_frontier(ids, done), 1, done).astype(_U8)
        ok = ids >= 0
        qi, c, s = _all(told, "qi", _I32).astype(_I64), _all(told, "c", _I64), _all(told, "s", _F32)
        zero = np.zeros(len(qi), _U8)
        u, v, flag = np.concatenate([np.nonzero(ok)[0], qi]), np.concatenate([ids[ok], c]), np.concatenate([done[ok], zero])
        ids, sims, done = _filled(len(ids), beam, u, v, np.concatenate([sims[ok], s]), flag)[:3]  # told are none of the ids
        return _table(_SEARCH, [(part, q, qid, qvec, ids, sims, done, int(((ids >= 0) & (done == 0)).sum()))])

    asks = _map(found.select("part", "ids", "done"), ask, "part long, back long, qi binary, node binary")
    told = _join(state.select("part", "ids"), asks, expand, pairs)
    wanted = _join(found.select("part", "q", "qvec", "ids", "sims"), told, gather, "part long, back long, qi binary, c binary, uq binary, qvec binary, bar binary")
    scored = _join(state.select("part", "vec"), wanted, score, pairs + ", s binary")
    return materialize(_join(found, scored, absorb, _SEARCH), "ann-search")


def settle(found: DataFrame, state: DataFrame, dim: int, beam: int) -> DataFrame:
    """Steps until nothing is left to expand."""
    while (found.agg(F.sum("todo")).first()[0] or 0) > 0:  # a node is expanded once for a query at most
        before, found = found, step(found, state, dim, beam)
        drop_table(before)
    return found


def search(state: DataFrame, dim: int, beam: int = BEAM) -> DataFrame:
    """Greedy search for all nodes that are asked for: `beam` nearest found, nearest first."""
    return settle(begin(state, dim, beam), state, dim, beam)


def sample(found: DataFrame, dim: int, beam: int, top: int = TOP) -> list:
    """SAMPLE of the searches, chosen by a hash: node, vector and `top` nearest found."""

    def choose(batches):
        best: list[tuple] = []
        for b in batches:
            for q, qvec, ids in _records(b, "q", "qvec", "ids"):
                q, qvec, ids = np.frombuffer(q, _I64), np.frombuffer(qvec, _F32).reshape(-1, dim), np.frombuffer(ids, _I64).reshape(-1, beam)
                h = (mix(q.astype(U64)) >> U64(1)).astype(_I64)
                best += [(int(h[i]), int(q[i]), qvec[i], ids[i, :top]) for i in np.argsort(h)[:SAMPLE]]
                best = sorted(best, key=lambda x: x[0])[:SAMPLE]
        yield from _table("h long, q long, qvec binary, ids binary", best).to_batches()

    return found.select("q", "qvec", "ids").mapInArrow(choose, "h long, q long, qvec binary, ids binary").orderBy("h", "q").limit(SAMPLE).collect()


def asking(state: DataFrame, only: list[int]) -> DataFrame:
    """`state`, where just these nodes, SAMPLE at most, are asked for."""
    masks: dict[int, np.ndarray] = {}
    for q in only:
        masks.setdefault(q >> SHIFT, np.zeros(1 << SHIFT, _U8))[q & _LOCAL] = 1
    few = state.sparkSession.createDataFrame([(p, bytearray(m.tobytes())) for p, m in masks.items()], "part long, asked binary")
    return state.drop("asked").join(F.broadcast(few), "part", "left").withColumn("asked", F.coalesce("asked", F.lit(bytearray())))


def recall(found: DataFrame, state: DataFrame, dim: int, beam: int, top: int = TOP) -> float:
    """Share of the `top` nearest nodes that the searches of sample() have found; these
    queries are held against all nodes."""
    rows = sample(found, dim, beam, top)
    if not rows:
        return 1.0
    qs, m = np.array([r["q"] for r in rows], _I64), np.stack([np.frombuffer(r["qvec"], _F32) for r in rows])
    sent = state.sparkSession.sparkContext.broadcast((qs, m))  # SAMPLE vectors at most

    def exact(batches):
        qs, m = sent.value
        u, v, s = np.zeros(0, _I64), np.zeros(0, _I64), np.zeros(0, _F32)
        for b in batches:
            for part, vec in _records(b, "part", "vec"):
                vec = np.frombuffer(vec, _F32).reshape(-1, dim)
                gid = part << SHIFT | np.arange(len(vec))
                sim = m @ vec.T
                sim[qs[:, None] == gid[None, :]] = -np.inf
                kk = min(top, len(vec))
                at, far = _top(sim, kk)
                u = np.concatenate([u, np.repeat(np.arange(len(qs)), kk)])
                v, s = np.concatenate([v, gid[at].ravel()]), np.concatenate([s, far.ravel()])
                o, _ = _nearest(u, v, s, top)
                u, v, s = u[o], v[o], s[o]
        at = [*_starts(u).tolist(), len(u)]
        yield from _table("qi long, v binary, s binary", [(int(u[x]), v[x:y], s[x:y]) for x, y in zip(at, at[1:])]).to_batches()

    def best_of(t: pa.Table) -> pa.Table:
        v, s = _all(t, "v", _I64), _all(t, "s", _F32)
        o = np.lexsort((v, -s))[:top]
        return _table("qi long, v binary", [(t.column("qi")[0].as_py(), v[o][s[o] > -np.inf])])

    near = state.select("part", "vec").mapInArrow(exact, "qi long, v binary, s binary").groupBy("qi").applyInArrow(best_of, "qi long, v binary").collect()
    hit = [len(np.intersect1d(np.frombuffer(r["v"], _I64), np.frombuffer(rows[r["qi"]]["ids"], _I64))) / max(1, len(r["v"]) // 8) for r in near]
    return float(np.mean(hit)) if hit else 1.0


def answers(found: DataFrame, state: DataFrame, beam: int, most: int = FINAL) -> DataFrame:
    """(id, other): vec_ids of the queries' nodes and of the `most` nearest found."""

    def ask(b):
        rows = []
        for qid, ids in _records(b, "qid", "ids"):
            qid, ids = np.frombuffer(qid, _I64), np.frombuffer(ids, _I64).reshape(-1, beam)[:, :most]
            q, c = np.repeat(qid, ids.shape[1])[ids.ravel() >= 0], ids[ids >= 0]
            o = np.argsort(c, kind="stable")
            q, c = q[o], c[o]
            rows += [(p, q[at], (c[at] & _LOCAL).astype(_I32)) for p, at in _by_part(c)]
        yield _table("part long, q binary, c binary", rows)

    def name(t: pa.Table, asks: pa.Table) -> pa.Table:
        own = np.frombuffer(t.column("own")[0].as_py(), _I64)
        return pa.table({"id": pa.array(_all(asks, "q", _I64)), "other": pa.array(own[_all(asks, "c", _I32)])})

    return _join(state.select("part", "own"), _map(found.select("qid", "ids"), ask, "part long, q binary, c binary"), name, "id long, other long")


def nearest(table: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id `every` divides."""
    vecs, kind = vectors(table)
    head = vecs.select(F.octet_length("key")).first()
    if head is None:
        return vecs.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = head[0] // np.dtype(kind).itemsize
    asked = F.max(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("asked")
    distinct = materialize(vecs.groupBy("key").agg(F.min("vec_id").alias("id"), asked, F.count("*").alias("copies")), "ann-distinct")
    size = distinct.count()
    # The first of equal vectors stand for all: a query has at most `top` of them besides itself.
    byvec = Window.partitionBy("key").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = vecs.select("vec_id", F.row_number().over(Window.partitionBy("key").orderBy("vec_id")).alias("nth"), F.min("vec_id").over(byvec).alias("other"))
    members = materialize(nth.where(F.col("nth") <= top + 1).select("other", F.col("vec_id").alias("member")), "ann-members")
    node = nodes(distinct, size, dim, kind)
    state, beam, r = neighbour_graph(node, dim, size), max(BEAM, 2 * top), 1 << 20
    found = search(state, dim, beam)
    if beam < size and recall(found, state, dim, beam, min(top, size - 1)) < TARGET:
        only, wide = [x["q"] for x in sample(found, dim, beam)], False
        drop_table(found)
        while not wide:
            before, state = state, descend(state, dim, r)
            drop_table(before)
            beam, r = 2 * beam, r + 1
            few = search(asking(state, only), dim, beam)
            wide = beam >= size or recall(few, state, dim, beam, min(top, size - 1)) >= TARGET
            drop_table(few)
        found = settle(begin(state, dim, beam), state, dim, beam)
    # A vector without copies is its own node.
    queries = salted_lookup(vecs.where(F.col("vec_id") % every == 0), ["key"], "vec_id", distinct.where("copies > 1").select("key", "id"))
    queries = materialize(queries.select(F.col("vec_id").alias("query_id"), F.coalesce("id", "vec_id").alias("id")), "ann-queries")
    own = queries.select("id").distinct()
    near = materialize(answers(found, state, beam, max(FINAL, 2 * top)).union(own.select("id", "id")), "ann-answers")
    near = near.join(distinct.select(F.col("id").alias("other"), F.col("key").alias("a")), "other").join(distinct.where("asked = 1").select("id", F.col("key").alias("b")), "id")

    def score(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.ascontiguousarray(_decoded(_flat(b.column(n), _U8), kind).reshape(b.num_rows, -1).T, float) for n in ("a", "b"))
                s = np.zeros(b.num_rows)
                for i in range(len(x)):  # in the order of components: equal vectors have equal scores
                    s += x[i] * y[i]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("other"), pa.array(s)], names=["id", "other", "score"])

    scored = near.select("id", "other", "a", "b").mapInArrow(score, "id long, other long, score double")
    scored = scored.join(members, "other").select("id", "member", "score")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "member")
    best = scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1)
    lists = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "member", "score"))).alias("near"))
    joined = salted_lookup(queries, ["id"], "query_id", lists)
    others = F.slice(F.filter("near", lambda x: x["member"] != F.col("query_id")), 1, top)
    flat = joined.select("query_id", F.posexplode(others).alias("p", "x"))
    return flat.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.member").alias("vec_id"), F.col("x.score").alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_ann": op4_ann}
ORACLE: dict[str, str] = {}
