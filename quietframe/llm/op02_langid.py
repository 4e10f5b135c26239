"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 characters) of the whole text, ASCII lower-cased
and with every other ASCII character taken as a space; a feature's value is its share
of the text's n-grams times its inverse document frequency, which counts all documents
that may be learned from.  Weights are learned with follow-the-regularised-leader (per
coordinate) under an elastic net, on the driver, from a bounded sample: at most SAMPLE
rows and SAMPLE_BYTES of text in all, dealt evenly over the languages and chosen by a
hash of doc_id.  Part of the sample is kept back to fit one temperature.

Contract for odd rows: `und` with score 0 for null text and text without a letter;
rows without text or lang teach nothing; rows come out as often as they stand, extra
columns unchanged; with nothing to learn from every row is `und`."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, fresh, pick, read_table
from .kernels import LOWER, U64, mix, row_slices, text_buffers, trim

#: Rows that the model is fitted on, at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
#: log2 of the hashed features.
BITS = 16
ORDERS = (1, 2, 3)
SCALE = 100.0
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.5
EPOCHS = 4

_TABLE = LOWER.copy()
_TABLE[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 0x20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed feature, row) of the n-grams of each order; rows ascend."""
    low = _TABLE[data]
    head = (low & 0xC0) != 0x80
    at = np.flatnonzero(head)
    code = low[at].astype(U64)
    pad = np.concatenate([low, np.zeros(4, np.uint8)])
    nxt = np.append(at[1:], len(low))
    for k in (1, 2, 3):
        more = nxt - at > k
        if not more.any():
            break
        code = np.where(more, code << U64(8) | pad[at + k].astype(U64), code)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    code = mix(code + U64(0x632BE5AB))
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            return
        h = np.full(m, U64(n), U64)
        for k in range(n):
            h = (h + code[k : k + m]) * U64(0x9E3779B97F4A7C15)
        same = row[: m] == row[n - 1 :]
        yield (h >> U64(64 - BITS)).astype(np.int64)[same], row[:m][same]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (features + 1, languages), with SCALE and idf in them; the last row is the bias
    temperature: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.langs)
        z, total = np.zeros((n, k)), np.zeros(n)
        for f, row in grams(data, offsets):
            total += np.bincount(row, minlength=n)
            for c in range(k):
                z[:, c] += np.bincount(row, self.columns[c][f], minlength=n)
        return z / np.maximum(total, 1)[:, None] + self.weights[-1]

    def __post_init__(self):
        self.columns = [np.ascontiguousarray(self.weights[:-1, c]) for c in range(len(self.langs))]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its calibrated probability for each row."""
        z = self.logits(data, offsets) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    n = len(offsets) - 1
    count = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for r in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode())
    assert len(out) == n
    return out


def fit(rows: list[tuple[int, str, str]], df: np.ndarray, n_docs: int) -> Model | None:
    """Learn from (doc_id, lang, text); `df` of `n_docs` documents have each feature."""
    rows = [r for r in rows if r[2] and any(c.isalpha() for c in r[2])]
    langs = sorted({r[1] for r in rows})
    if not langs:
        return None
    feats: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, text in rows:
        data, off = text_buffers(pa.array([text]))
        f = np.concatenate([g for g, _ in grams(data, off)] or [np.zeros(0, np.int64)])
        u, c = np.unique(f, return_counts=True)
        feats.append((u.astype(np.int32), (c / max(1, len(f))).astype(np.float32)))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    kept = np.array([zlib.crc32(f"calibrate {r[0]}".encode()) % 6 == 0 for r in rows])
    y = np.array([langs.index(r[1]) for r in rows])
    dim, k = (1 << BITS) + 1, len(langs)
    z, n = np.zeros((dim, k)), np.zeros((dim, k))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for r in rng.permutation(np.flatnonzero(~kept) if (~kept).any() else np.arange(len(rows))):
            i = np.append(feats[r][0], dim - 1)
            x = np.append(SCALE * feats[r][1] * idf[feats[r][0]], 1.0)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(slice(None))
    w[:-1] *= SCALE * idf[:, None]
    model = Model(langs, w.astype(np.float64), 1.0)
    held = np.flatnonzero(kept) if kept.any() else np.arange(len(rows))
    s = np.array([feats[r][1] @ model.weights[feats[r][0]] + model.weights[-1] for r in held])

    def loss(t):
        q = s / t
        q = q - q.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(held)), y[held]]))

    model.temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss))
    return model


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all `texts` (text) with a letter have each feature, and how many there are."""
    slices = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for b in batches:
            data, off = text_buffers(b.column("text"))
            for i, j in row_slices(off, 1 << 20):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ok = np.flatnonzero(has_letter(part, at))
                got = [(f, np.searchsorted(row, np.arange(len(at)))) for f, row in grams(part, at)]
                n += len(ok)
                for r in ok.tolist():
                    seen[:] = False
                    for f, ends in got:
                        seen[f[ends[r] : ends[r + 1]]] = True
                    df += seen
        trim()
        if n:
            parts = df.reshape(slices, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([n] * slices, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "n", "df"])

    def add(t: pa.Table) -> pa.Table:
        df = np.zeros((1 << BITS) // slices, np.int64)
        for x in t.column("df"):
            df += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"slice": t.column("slice")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})

    schema = "slice int, n long, df binary"
    got = sorted(texts.mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema).collect())  # 64 rows
    if not got:
        return np.zeros(1 << BITS), 0
    return np.concatenate([np.frombuffer(r["df"], np.int64) for r in got]).astype(float), got[0]["n"]


def sample(docs: DataFrame, rows: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, `label` and text of at most `most` rows of `rows` (doc_id, label) and
    `most_bytes` of text, as much for each label, chosen by a hash of doc_id."""
    kinds = max(1, rows.select(label).distinct().count())
    first = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.distinct().withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= max(1, most // kinds)).drop("_nth")
    got = [tuple(r) for r in chosen.collect()]  # at most `most` small rows
    if not got:
        return docs.sparkSession.createDataFrame([], T.StructType([rows.schema["doc_id"], rows.schema[label], T.StructField("text", T.StringType())]))
    small = docs.sparkSession.createDataFrame(got, rows.schema)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(small), "doc_id").select("doc_id", label, "text")
    before = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    return texts.withColumn("_bytes", F.sum(F.octet_length("text")).over(before)).where(F.coalesce("_bytes", F.lit(0)) <= most_bytes // kinds).drop("_bytes")


def train(docs: DataFrame, most: int = SAMPLE) -> Model | None:
    """Fit on `docs` (doc_id, text, lang), without rows whose crc32(doc_id) mod 3 is 1."""
    rows = docs.where(docs["`lang`"].isNotNull() & docs["`text`"].isNotNull() & docs["`doc_id`"].isNotNull() & (crc_of_id(docs["`doc_id`"]) % 3 != 1))
    chosen = sorted({tuple(r) for r in sample(rows, pick(rows, "doc_id", "lang"), "lang", most).collect()})
    return fit(chosen, *frequencies(pick(rows, "text"))) if chosen else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with _lang and _score (underscores before them where `docs` has such names)."""
    new = [fresh(docs.columns, c) for c in ("_lang", "_score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features x languages at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            data, off = text_buffers(b.column("text"))
            langs, scores = [], []
            for i, j in row_slices(off, 1 << 20):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ok = has_letter(part, at)
                best, p = m.predict(part, at) if m else (np.zeros(j - i, int), np.zeros(j - i))
                langs += [m.langs[k] if m and o else "und" for k, o in zip(best.tolist(), ok.tolist(), strict=True)]
                scores += np.where(ok, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *new])
        trim()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())]))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    p = predict(pick(docs, "doc_id", "text"), train(docs))
    return p.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


QUERIES = {"op2_langid": op2_langid}
ORACLE: dict[str, str] = {}
