"""Quality classifier: a byte-level convolutional network in numpy.

``FILTERS`` filters over ``WIDTH`` bytes, applied at every ``STEP``-th byte, are tables of one
weight vector per byte value and place, so that a response is a sum of look-ups. Responses are
max-pooled in chunks of ``CHUNK`` bytes that overlap by half and cover the whole document; each chunk gets a logit
from its rectified maxima, and the mean of the logits, shifted by the log odds of the classes over
all training labels, becomes one probability.

The network is fitted on the driver on at most ``SAMPLE`` labelled documents of each class, of those with at
most ``SAMPLE_BYTES`` bytes the ones least by a hash of their id; that is the only bounded step. Rows with
crc32(doc_id) mod 5 = 0 are held out. Scores depend on the text alone.

Defined cases: null and empty texts are scored as one chunk of padding; texts shorter than a filter
are padded; documents with a null id are scored and never held out; repeated rows get equal scores;
without labels of both classes every score is the share of label 1 (0.5 without any); an id that is labelled
both 0 and 1 teaches nothing and doesn't count; of several documents with one labelled id the one with the
least text hash, then text, is learned; extra columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bounded_batches

FILTERS, WIDTH, STEP, CHUNK = 32, 8, 4, 512
HALF = CHUNK // 2
SAMPLE, SAMPLE_BYTES, EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 1500, 1 << 16, 6, 300, 48, 0.02, 20
FOLDS, THRESHOLD = 5, 0.3


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: float
    log_odds: float


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def halves(size: int) -> int:
    """Half chunks that cover a document of so many bytes; two at least."""
    return max(2, -(-size // HALF))


def _padded(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each row padded by zeros to whole half chunks and WIDTH more, and the halves' row offsets."""
    n = np.array([halves(x) for x in np.diff(o)], np.int64)
    size = n * HALF + WIDTH
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    out[K.ragged(at[:-1], np.diff(o))] = b
    return out, np.concatenate([[0], np.cumsum(n)])


def _starts(n: np.ndarray) -> np.ndarray:
    """First byte of every half chunk in the padded bytes, for rows of n half chunks."""
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) * HALF + row * WIDTH


def pooled(b: np.ndarray, start: np.ndarray, tables: np.ndarray, block: int = 256) -> np.ndarray:
    """Highest response of every filter in each half chunk."""
    out = np.empty((len(start), tables.shape[2]), np.float32)
    inner = np.arange(0, HALF, STEP)
    for lo in range(0, len(start), block):
        p = (start[lo : lo + block, None] + inner[None, :]).ravel()
        r = tables[0][b[p]]
        for j in range(1, WIDTH):
            r += tables[j][b[p + j]]
        out[lo : lo + block] = r.reshape(-1, len(inner), tables.shape[2]).max(axis=1)
    return out


def _chunk_rows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First half of every chunk, and its row."""
    at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n - 1)
    return K.ragged(at[:-1], n - 1), row


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    data, at = K.texts(column)
    out = []
    for lo, hi in K.slices(at):
        b, h = _padded(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        n = np.diff(h)
        top = pooled(b, _starts(n), model.tables)
        first, row = _chunk_rows(n)
        feature = np.maximum(np.maximum(top[first], top[first + 1]) + model.bias, 0)
        logit = np.bincount(row, feature @ model.out, hi - lo) / (n - 1) + model.offset + model.log_odds
        out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str | None], labels: np.ndarray, ones: int, zeros: int) -> Model:
    """Adam on the mean log loss over balanced batches."""
    random = np.random.default_rng(SEED)
    odds = float(np.log((ones + 1) / (zeros + 1)))
    tables = random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    model = Model(tables, np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0, odds)
    if len(set(labels.tolist())) < 2:
        return model
    model.out = random.normal(0, 0.1, FILTERS).astype(np.float32)
    data, at = K.texts(pa.array(texts, pa.string()))
    by_class = [np.flatnonzero(labels == c) for c in (0, 1)]
    steps = max(LEAST_STEPS, EPOCHS * len(labels) // BATCH)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("tables", model.tables), ("bias", model.bias), ("out", model.out))}
    state["offset"] = [0.0, 0.0]
    inner = np.arange(0, CHUNK, STEP)
    for step in range(1, steps + 1):
        pick = np.concatenate([random.choice(ix, BATCH // 2) for ix in by_class])
        b = np.concatenate([data[at[i] : at[i + 1]] for i in pick])
        o = np.concatenate([[0], np.cumsum(at[pick + 1] - at[pick])])
        b, h = _padded(b, o)
        n = np.diff(h)
        first, row = _chunk_rows(n)
        start = _starts(n)[first]
        top = np.empty((len(start), FILTERS), np.float32)
        where = np.empty((len(start), FILTERS), np.int64)
        for lo in range(0, len(start), 128):
            p = start[lo : lo + 128, None] + inner[None, :]
            r = model.tables[0][b[p]]
            for j in range(1, WIDTH):
                r += model.tables[j][b[p + j]]
            best = r.argmax(axis=1)
            top[lo : lo + 128] = np.take_along_axis(r, best[:, None, :], 1)[:, 0]
            where[lo : lo + 128] = np.take_along_axis(p, best, 1)
        z = top + model.bias
        feature = np.maximum(z, 0)
        logit = np.bincount(row, feature @ model.out, len(pick)) / (n - 1) + model.offset
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) / len(pick)
        of_chunk = (error / (n - 1))[row].astype(np.float32)
        back = of_chunk[:, None] * model.out[None, :] * (z > 0)
        slope = np.zeros(model.tables.size, np.float32)
        column = np.arange(FILTERS)
        for j in range(WIDTH):
            slope += np.bincount(((j * 256 + b[where + j].astype(np.int64)) * FILTERS + column).ravel(), back.ravel(), slope.size).astype(np.float32)
        slopes = {"tables": slope.reshape(model.tables.shape), "bias": back.sum(0), "out": feature.T @ of_chunk, "offset": float(error.sum())}
        rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, g in slopes.items():
            first_m, second = state[k]
            state[k] = [0.9 * first_m + 0.1 * g, 0.999 * second + 0.001 * g * g]
            change = rate * (state[k][0] / (1 - 0.9**step)) / (np.sqrt(state[k][1] / (1 - 0.999**step)) + 1e-7)
            setattr(model, k, getattr(model, k) - change)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled rows that aren't held out."""
    mine = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    mine = mine.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    counts = {r[0]: r[1] for r in mine.groupBy("quality").count().collect()}
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    fit_for = mine.join(texts.select("doc_id"), "doc_id", "left_semi")
    picked = fit_for.where("quality = 0").orderBy(*order).limit(sample).union(fit_for.where("quality = 1").orderBy(*order).limit(sample))
    # The sample holds 2 * sample ids at most, whatever the tables hold.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).getField("text").alias("text"))
    rows = sorted(rows.select("doc_id", "text", "quality").collect(), key=lambda r: r[0])
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), counts.get(1, 0), counts.get(0, 0))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = score_texts(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
