"""Toxicity: a convolutional text classifier in numpy.

Words (letters and digits, ASCII lower-cased) get the sum of four hashed embeddings,
two of the whole word and two of its first STEM characters, so that inflected forms
share what was learned; filters of one, two and three words, max pooling over the whole text, and a logistic
output.  It is trained on the driver with Adagrad on a bounded sample: at most SAMPLE
labelled rows and SAMPLE_BYTES of text, as many of either label, chosen by a hash of
doc_id.  A part of it is kept back; that and all labelled rows beyond the sample give a
threshold for each language, from a histogram of their logits, so that thresholds follow
the labels as they are, not as the sample balances them.  The language is a guess from
the text's own words (naive Bayes over the same hashes, learned from the sample), never
the lang column; a language with few cases takes the common threshold.  The score is
the logistic of the logit less the threshold, so 0.5 is the cut in each language.

Contract for odd rows: null and empty text get the score of a text without words;
rows without label or text teach nothing; a document with both labels teaches both;
rows come out as often as they stand, extra columns unchanged; with nothing to learn
from every score is 0."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, fresh, materialize, pick, read_table
from .kernels import ALNUM_WORD, LOWER, U64, mix, prefix_sums, row_slices, span_hashes, text_buffers, trim, words
from .op02_langid import sample

SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
#: Width of the bins of the logits' histogram, and the greatest logit told apart.
BIN, FAR = 0.02, 60.0
BITS, DIM, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.1, 1e-4
#: Characters of a word's stem.
STEM = 4
#: Rows of either label that a language's own threshold needs.
FEW = 20


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four table rows for each word (4, words), and the words' rows."""
    low = LOWER[data]
    ws, we, row = words(low, offsets, ALNUM_WORD)
    heads = np.flatnonzero((low & 0xC0) != 0x80)
    stem = np.append(heads, [len(low)] * STEM)[np.searchsorted(heads, ws) + STEM]
    sums = prefix_sums(low)
    out = np.empty((4, len(ws)), np.int32)
    for k, end in ((0, we), (2, np.minimum(stem, we))):
        h = mix(span_hashes(sums, ws, end) + U64(k))
        out[k], out[k + 1] = h >> U64(64 - BITS), h >> U64(8) & U64((1 << BITS) - 1)
    return out, row


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # of width k: (k, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    langs: list[str] = field(default_factory=list)
    lang_table: np.ndarray | None = None  # (2 ** BITS, languages), log-likelihood
    lang_prior: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    fitted: list[int] = field(default_factory=list)  # doc_ids that the weights were learned from

    def pooled(self, idx: np.ndarray, row: np.ndarray, n: int):
        """Max of each filter over each text (that of unknown words where it has no
        window), and where it is."""
        e = self.table[idx[0]] + self.table[idx[1]] + self.table[idx[2]] + self.table[idx[3]]
        out, at = [], []
        for w, c in zip(self.filters, self.bias, strict=True):
            k = len(w)
            m = len(e) - k + 1
            top, arg = np.tile(np.maximum(c, 0), (n, 1)), np.full((n, FILTERS), -1)
            if m > 0:
                s = e[:m] @ w[0]
                for i in range(1, k):
                    s += e[i : i + m] @ w[i]
                ok = np.flatnonzero(row[:m] == row[k - 1 :])
                if len(ok):
                    s, r = np.maximum(s[ok] + c, 0), row[:m][ok]
                    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    best = np.maximum.reduceat(s, start)
                    top[r[start]] = best
                    if self.training:
                        for x, y in zip(start, np.append(start[1:], len(r)), strict=True):
                            arg[r[x]] = ok[x + s[x:y].argmax(0)]
            out.append(top)
            at.append(arg)
        return e, np.concatenate(out, 1), at

    training = False

    def logits(self, idx, row, n) -> np.ndarray:
        return self.pooled(idx, row, n)[1] @ self.out + self.out_bias

    def guess(self, idx: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Index of the likeliest language of each text."""
        s = np.stack([np.bincount(row, self.lang_table[idx[0], k], minlength=n) for k in range(len(self.langs))], 1)
        return (s + self.lang_prior).argmax(1)

    def seen(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and index of the guessed language of each text."""
        idx, row = hashed(data, offsets)
        n = len(offsets) - 1
        return self.logits(idx, row, n), self.guess(idx, row, n)


def _encode(texts: list[str]):
    data, off = text_buffers(pa.array(texts))
    return hashed(data, off)


def fit(rows: list[tuple[int, int, str, str | None]]) -> Model | None:
    """Learn from (doc_id, toxic, text, lang); lang serves the thresholds only."""
    rows = [r for r in rows if r[2]]
    if len({r[1] for r in rows}) < 2:
        return None
    rng = np.random.default_rng(3)
    m = Model(np.zeros((1 << BITS, DIM), np.float32), [rng.normal(0, 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS], [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    encoded = [_encode([r[2]])[0] for r in rows]
    y = np.array([r[1] for r in rows], np.float32)
    kept = np.array([zlib.crc32(f"calibrate {r[0]}".encode()) % 5 == 0 for r in rows])
    own = np.flatnonzero(~kept)
    if len(set(y[own])) < 2 or len(set(y[kept])) < 2:
        own, kept = np.arange(len(rows)), np.ones(len(rows), bool)
    sums: list[np.ndarray] = [np.full_like(p, 1e-3) for p in (*m.filters, *m.bias, m.out)]
    table_sum, bias_sum = np.full((1 << BITS, 1), 1e-3, np.float32), 1e-3
    m.training = True
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        order = rng.permutation(own)
        for s in range(0, len(order), BATCH):
            part = order[s : s + BATCH]
            words_ = np.concatenate([encoded[i] for i in part], 1)
            row = np.repeat(np.arange(len(part)), [encoded[i].shape[1] for i in part])
            e, x, at = m.pooled(words_, row, len(part))
            z = x @ m.out + m.out_bias
            d = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
            gx = d[:, None] * m.out
            grads = [np.zeros_like(p) for p in (*m.filters, *m.bias)]
            place, ge = [], []
            for f, w in enumerate(m.filters):
                g, where = gx[:, f * FILTERS : (f + 1) * FILTERS], at[f]
                on = (where >= 0) & (x[:, f * FILTERS : (f + 1) * FILTERS] > 0)
                r, c = np.nonzero(on)
                gv, pos = g[r, c], where[r, c]
                np.add.at(grads[len(m.filters) + f], c, gv)
                for i in range(len(w)):
                    for k in range(FILTERS):
                        sel = c == k
                        grads[f][i, :, k] += gv[sel] @ e[pos[sel] + i]
                    place.append(pos + i)
                    ge.append(gv[:, None] * w[i][:, c].T)
            params = (*m.filters, *m.bias, m.out)
            for p, g, q in zip(params, (*grads, x.T @ d), sums, strict=True):
                g = g + DECAY * p
                q += g * g
                p -= rate * g / np.sqrt(q)
            bias_sum += float(d.sum()) ** 2
            m.out_bias -= rate * float(d.sum()) / bias_sum**0.5
            if place:
                pos, g = np.concatenate(place), np.concatenate(ge)
                u, inv = np.unique(words_[:, pos].ravel(), return_inverse=True)
                gu = np.zeros((len(u), DIM), np.float32)
                np.add.at(gu, inv, np.tile(g, (4, 1)))
                table_sum[u] += (gu * gu).mean(1, keepdims=True)
                m.table[u] -= rate * gu / np.sqrt(table_sum[u])
    m.training = False
    m.langs = sorted({r[3] or "" for r in rows})
    counts = np.full((1 << BITS, len(m.langs)), 0.1, np.float32)
    for own_words, r in zip(encoded, rows, strict=True):
        np.add.at(counts[:, m.langs.index(r[3] or "")], own_words[0], 1)
    m.lang_table = np.log(counts / counts.sum(0))
    m.lang_prior = np.log(np.array([sum((r[3] or "") == x for r in rows) for x in m.langs]) / len(rows))
    m.fitted = [] if kept.all() else sorted({rows[i][0] for i in own})
    return m


def thresholds(counts: np.ndarray) -> np.ndarray:
    """Cut of each language from counts (languages, bins, label); `_threshold` of a
    language with FEW of either label, else of all."""
    base = _threshold(counts.sum(0))
    return np.array([_threshold(c) if c.sum(0).min() >= FEW else base for c in counts])


def _threshold(counts: np.ndarray) -> float:
    """The cut of best F1, in the middle of its gap, of counts (bins, label)."""
    bins = np.flatnonzero(counts.sum(1))[::-1]
    if not len(bins) or not counts[:, 1].any():
        return 0.0
    taken, hit = np.cumsum(counts[bins].sum(1)), np.cumsum(counts[bins, 1])
    k = int((2 * hit / (taken + counts[:, 1].sum())).argmax())
    low = bins[k] * BIN - FAR  # lower edge of the last bin above the cut
    return float((low + (bins[k + 1] + 1) * BIN - FAR) / 2 if k + 1 < len(bins) else low)


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) that may be learned from: crc32(doc_id) mod 5 is not 0."""
    rows = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(crc_of_id(F.col("doc_id")) % 5 != 0)
    return rows.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))


def train_weights(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """Fit the network, not the thresholds."""
    chosen = materialize(sample(docs, _labelled(labels), "toxic", most, SAMPLE_BYTES), "toxicity-sample")
    ids = chosen.select("doc_id").distinct()
    langs = dict(pick(docs, "doc_id", "lang").where("lang is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("lang")).collect())
    got = sorted({(r["doc_id"], r["toxic"], r["text"]) for r in chosen.where("text is not null").collect()})
    return fit([(*r, langs.get(r[0])) for r in got])


def calibrate(seen: DataFrame, labels: DataFrame, model: Model) -> Model:
    """`model` with thresholds, from all labelled texts that its weights don't know; `seen`
    is of seen_by()."""
    spark = seen.sparkSession
    rows = seen.where("_some").select("doc_id", "_logit", "_guess").join(_labelled(labels).distinct(), "doc_id")
    if model.fitted:  # as many as the sample has rows, at most
        rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in model.fitted], "doc_id long")), "doc_id", "left_anti")
    bin_ = F.floor((F.least(F.greatest("_logit", F.lit(-FAR)), F.lit(FAR)) + FAR) / BIN).cast("int")
    got = rows.groupBy("_guess", bin_.alias("bin"), "toxic").count().collect()  # languages x bins x labels at most
    counts = np.zeros((len(model.langs), int(2 * FAR / BIN) + 2, 2), np.int64)
    for r in got:
        counts[r["_guess"], r["bin"], r["toxic"]] = r["count"]
    model.thresholds = thresholds(counts)
    return model


def logits(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with _logit and _guess (index of the guessed language); underscores come
    before these where `docs` has such names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded tables
    new = [fresh(docs.columns, c) for c in ("_logit", "_guess")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            data, off = text_buffers(b.column("text"))
            out = [m.seen(data[off[i] : off[j]], off[i : j + 1] - off[i]) if m else (np.zeros(j - i), np.zeros(j - i, int)) for i, j in row_slices(off, 1 << 20)]
            z, g = (np.concatenate([*(x[k] for x in out), np.zeros(0)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.float64()), pa.array(g.astype(np.int32))], names=[*b.schema.names, *new])
        trim()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.IntegerType())]))


def scored(seen: DataFrame, model: Model | None, logit: str = "_logit", guess: str = "_guess"):
    """Score (0 to 1) of a frame that logits() gave; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    cut = F.element_at(F.array(*[F.lit(float(x)) for x in model.thresholds]), F.col(guess) + 1)
    return 1 / (1 + F.exp(F.least(F.greatest(cut - F.col(logit), F.lit(-FAR)), F.lit(FAR))))


def seen_by(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, _logit, _guess and whether there is a text."""
    return logits(pick(docs, "doc_id", "text"), model).select("doc_id", "_logit", "_guess", (F.coalesce(F.octet_length("text"), F.lit(0)) > 0).alias("_some"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0; reads all texts once more
    for the thresholds."""
    model = train_weights(docs, labels, most)
    return calibrate(seen_by(docs, model), labels, model) if model else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with _toxicity (0 to 1; underscores before it where `docs` has such a name)."""
    logit, guess = (fresh(docs.columns, c) for c in ("_logit", "_guess"))
    seen = logits(docs, model)
    return seen.select(*[f"`{c}`" for c in docs.columns], scored(seen, model, logit, guess).alias(fresh(docs.columns, "_toxicity")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train_weights(docs, labels)
    # Texts are read once: thresholds and scores come from the same logits.
    seen = materialize(seen_by(docs, model), "toxicity-logits")
    if model:
        calibrate(seen, labels, model)
    s = seen.select("doc_id", scored(seen, model).alias("score"))
    return s.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
