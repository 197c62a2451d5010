"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over the whole document. Their outputs, rectified, are max-pooled
in chunks of two strides that overlap by one; the largest and the mean of the chunks give the
features of one logistic output. As the input is bytes, a filter is a table of weights by
place and byte, and the convolution a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fitting_rows, giving_back

#: Bytes a filter sees, filters, bytes of a stride (a chunk is two).
WIDTH, FILTERS, STRIDE = 4, 16, 256
#: Strides convolved at a time, so that the arrays stay in the cache and a long text needs no more memory.
BLOCK = 256
#: The most labelled rows that a model is fitted on, the most bytes of their texts, and the passes over them.
SAMPLE, TEXTS, EPOCHS = 4000, 64 << 20, 10


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each between zeros in strides of its own, and the texts' first strides.

    The zeros before a text are as many as a filter reaches ahead, so no filter's place in one text sees another.
    """
    sizes = np.array([-(-(len(t) + WIDTH - 1) // STRIDE) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.zeros(first[-1] * STRIDE + WIDTH, np.uint8)
    for t, at in zip(texts, first, strict=False):
        begin = at * STRIDE + WIDTH - 1
        flat[begin : begin + len(t)] = np.frombuffer(t, np.uint8)
    return flat, first


def pooled(model: dict, flat: np.ndarray, count: int, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest output of each filter in each stride, and where it is if ``places``."""
    top = np.empty((count, FILTERS), np.float32)
    where = np.empty((count, FILTERS), np.int64) if places else None
    for at in range(0, count, BLOCK):
        n = min(BLOCK, count - at)
        part = flat[at * STRIDE : (at + n) * STRIDE + WIDTH].astype(np.intp)
        out = model["w"][0].take(part[: n * STRIDE], axis=0)
        for j in range(1, WIDTH):
            out += model["w"][j].take(part[j : n * STRIDE + j], axis=0)
        out = out.reshape(n, STRIDE, FILTERS)
        if places:
            arg = out.argmax(axis=1)
            where[at : at + n] = arg + (np.arange(at, at + n) * STRIDE)[:, None]
            top[at : at + n] = np.take_along_axis(out, arg[:, None, :], axis=1)[:, 0]
        else:
            out.max(axis=1, out=top[at : at + n])
    return np.maximum(top + model["b"], 0), where


def features(top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the maximum and the mean over its chunks; and the chunks: stride i with i + 1, the last alone."""
    chunks = top.copy()
    inner = np.ones(len(top), bool)
    inner[first[1:] - 1] = False
    i = np.flatnonzero(inner)
    chunks[i] = np.maximum(top[i], top[i + 1])
    begin, sizes = first[:-1], np.diff(first)
    return np.hstack([np.maximum.reduceat(chunks, begin), np.add.reduceat(chunks, begin) / sizes[:, None]]), chunks


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each text; an empty text is a stride of zeros."""
    if not texts:
        return np.empty(0)
    flat, first = padded(texts)
    top, _ = pooled(model, flat, first[-1])
    return sigmoid(features(top, first)[0] @ model["u"] + model["c"])


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 7) -> dict:
    """Train by Adam on the log loss. Without both labels the model scores every text by their smoothed share."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    model = {
        "w": (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32),
        "u": np.zeros(2 * FILTERS),
        "c": np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))]),
    }
    model["w"][:, 0] = 0  # padding
    if not 0 < y.sum() < len(y):
        return model
    model["u"] = rng.standard_normal(2 * FILTERS) * 0.1
    moments = {k: [np.zeros(v.shape), np.zeros(v.shape)] for k, v in model.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            flat, first = padded([texts[i] for i in pick])
            top, where = pooled(model, flat, first[-1], places=True)
            x, chunks = features(top, first)
            d = (sigmoid(x @ model["u"] + model["c"]) - y[pick]) / len(pick)
            dx = d[:, None] * model["u"]
            sizes = np.diff(first)
            # To chunks: the mean's share, and to each text's largest chunk; then to the stride that gave the chunk.
            dc = np.repeat(dx[:, FILTERS:] / sizes[:, None], sizes, axis=0)
            for t in range(len(pick)):
                dc[first[t] + chunks[first[t] : first[t + 1]].argmax(axis=0), np.arange(FILTERS)] += dx[t, :FILTERS]
            later = chunks > top
            dt = np.where(later, 0, dc)
            dt[1:] += np.where(later, dc, 0)[:-1]
            dt *= top > 0
            grads = {"w": np.zeros(model["w"].shape), "b": dt.sum(axis=0), "u": x.T @ d, "c": np.array([d.sum()])}
            s, f = np.nonzero(dt)
            for j in range(WIDTH):
                cell = flat[where[s, f] + j].astype(np.int64) * FILTERS + f
                grads["w"][j] += np.bincount(cell, dt[s, f], 256 * FILTERS).reshape(256, FILTERS)
            grads["w"][:, 0] = 0
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] = (model[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(model[k].dtype)
    return model


def held_out(id_col):
    """True for the rows that no model learns from: CRC-32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on at most ``sample`` labelled rows that aren't held out, those whose identifiers hash lowest, of at most ``TEXTS`` bytes together.

    Only the chosen labels, at most ``sample``, are broadcast; of several labels of an identifier the least counts. Of rows that
    share an identifier one is fitted on. Rows with a null label or text are left out.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = fitting_rows(rows, "id", "text", TEXTS)
    found.sort(key=lambda r: r["id"])
    return fit([r["text"].encode() for r in found], [r["label"] for r in found])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: id, held_out, score (0 to 1, higher where label 1 is likelier), predicted.

    A null text is empty, and an empty text has the score of padding. Nothing but the text enters a score. Rows stand
    alone, so repeats and null identifiers (not held out) get rows too; other columns play no part. Without labels every score is 0.5.
    """
    model = train(docs, labels, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, at = batch.column(1).cast(pa.binary()), [], 0
            while at < len(texts):  # about a megabyte at a time
                part, size = [], 0
                while at < len(texts) and size < 1 << 20:
                    part.append(texts[at].as_py() or b"")
                    size += len(part[-1])
                    at += 1
                scores.append(score(model, part))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(giving_back(run), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` scored 0.5 or more, all columns.

    A null text is empty. Rows stand alone: repeated rows and null identifiers stay or go by their texts. No rows give no rows.
    """
    model = train(docs, labels, sample, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(at).cast(pa.binary())]
            good, size, part = [], 0, []
            for t in [*texts, None]:
                if t is not None:
                    part.append(t)
                    size += len(t)
                if part and (t is None or size >= 1 << 20):
                    good.append(score(model, part) >= 0.5)
                    part, size = [], 0
            yield batch.filter(pa.array(np.concatenate(good) if good else np.empty(0, bool)))

    return docs.mapInArrow(giving_back(run), docs.schema)
