"""Language identification by a byte convolutional network, trained in numpy.

Filters of two, three and four bytes slide over windows of ``WINDOW`` bytes; the maximum of each
filter over a window goes through a rectifier into a softmax over the languages. The weights of a
filter are one number for each byte value and place, so a filter's answer is a sum of looked-up
numbers; for prediction the first two and the last two places are joined into tables by byte pair.

A text of any length is cut into windows that cover every byte. Its score for a language is the mean
of its windows' probabilities, weighted by their lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagepress.llm.common import ddl, id_remainder, text_bytes

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
SAMPLE_ROWS = 6000  # labelled rows that the network is fitted on, at most
SAMPLE_CHARS = 600  # code points taken from each of them, from a place chosen by hash
STEPS, BATCH, RATE = 500, 128, 0.02
BLOCK = 1 << 14  # positions worked on together
PAD = max(WIDTHS)
UNKNOWN = "und"
HELD_OUT, FOLDS = 2, 4


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [draw.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        hidden = FILTERS * len(WIDTHS)
        self.dense = draw.normal(0, 0.1, (hidden, max(1, len(labels)))).astype(np.float32)
        self.bias = np.zeros(max(1, len(labels)), np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums by byte pair: for the first two places of all filters, and for the rest of the wider ones."""
        two, three, four = self.filters
        first = [f[0][:, None, :] + f[1][None, :, :] for f in (two, three, four)]
        rest = [np.broadcast_to(three[2][:, None, :], (256, 256, FILTERS)), four[2][:, None, :] + four[3][None, :, :]]
        return (
            np.concatenate(first, axis=2).reshape(65536, -1),
            np.concatenate(rest, axis=2).reshape(65536, -1),
        )

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.dense + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with padding after each text; start, end and text number of each window."""
    data = np.frombuffer(b"".join(t + bytes(PAD) for t in texts) + bytes(PAD), dtype=np.uint8)
    starts, ends, owner, at = [], [], [], 0
    for n, text in enumerate(texts):
        for start in range(0, len(text), WINDOW):
            starts.append(at + start)
            ends.append(at + min(start + WINDOW, len(text)))
            owner.append(n)
        at += len(text) + PAD
    return data, np.array(starts, np.int64), np.array(ends, np.int64), np.array(owner, np.int64)


def pool(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables) -> np.ndarray:
    """Maximum of every filter over each window."""
    first, rest = tables
    out = np.empty((len(starts), FILTERS * len(WIDTHS)), np.float32)
    per = max(1, BLOCK // WINDOW)
    for i in range(0, len(starts), per):
        lo, hi = starts[i], ends[min(i + per, len(starts)) - 1]
        part = data[lo : hi + PAD].astype(np.int64)
        pair = part[:-1] * 256 + part[1:]
        n = hi - lo + 1
        sums = first[pair[:n]]
        sums[:, FILTERS:] += rest[pair[2 : n + 2]]
        edges = np.stack([starts[i : i + per], ends[i : i + per]], axis=1).reshape(-1) - lo
        out[i : i + per] = np.maximum.reduceat(sums, edges, axis=0)[::2]
    return out


def train(rows: list[tuple[bytes, str]]) -> Network:
    """Fit the network to labelled texts, by Adam on windows of many lengths; the result is repeatable."""
    network = Network(sorted({label for text, label in rows if text}))
    number = {label: i for i, label in enumerate(network.labels)}
    texts = [(t, number[label]) for t, label in rows if t]
    if len(network.labels) < 2:
        return network
    by_label = [[t for t, n in texts if n == i] for i in range(len(number))]
    draw = np.random.default_rng(11)
    weights = [*network.filters, network.dense, network.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        gold = draw.integers(0, len(number), BATCH)
        batch = []
        for n in gold:
            text = by_label[n][draw.integers(0, len(by_label[n]))]
            length = min(len(text), int(2 ** draw.uniform(3, 8)))
            at = draw.integers(0, len(text) - length + 1)
            batch.append(text[at : at + length])
        slopes = _slopes(network, batch, gold)
        for w, g, m, v in zip(weights, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            scale = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            w -= scale * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def _slopes(network: Network, batch: list[bytes], gold: np.ndarray) -> list[np.ndarray]:
    data = np.zeros((len(batch), WINDOW + PAD), np.int64)
    for i, text in enumerate(batch):
        data[i, : len(text)] = np.frombuffer(text, np.uint8)
    real = np.arange(WINDOW) < np.array([len(t) for t in batch])[:, None]
    pooled, places = [], []
    for width, f in zip(WIDTHS, network.filters, strict=True):
        sums = sum(f[j][data[:, j : j + WINDOW]] for j in range(width))
        sums = np.where(real[:, :, None], sums, -np.inf)
        places.append(sums.argmax(axis=1))
        pooled.append(np.take_along_axis(sums, places[-1][:, None, :], axis=1)[:, 0])
    pooled = np.concatenate(pooled, axis=1)
    missed = network.probabilities(pooled)
    missed[np.arange(len(gold)), gold] -= 1
    missed /= len(gold)
    active = np.maximum(pooled, 0)
    down = (missed @ network.dense.T) * (pooled > 0)
    out, rows = [], np.arange(len(batch))[:, None]
    for k, (width, f) in enumerate(zip(WIDTHS, network.filters, strict=True)):
        slope = np.zeros_like(f)
        part = down[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(width):
            np.add.at(slope[j], (data[rows, places[k] + j], np.arange(FILTERS)[None, :]), part)
        out.append(slope)
    return [*out, active.T @ missed, missed.sum(axis=0)]


def labelled_sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """At most ``SAMPLE_ROWS`` labelled passages, about as many for each language, chosen by a hash.

    Only the number of rows of each language and the sample itself reach the driver.
    """
    rows = docs.filter("lang is not null and text is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = max(1, SAMPLE_ROWS // len(counts))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(1 << 30))
    rate = F.get(
        F.from_json(F.lit("[" + ",".join(str(min(1.0, share / counts[c])) for c in sorted(counts)) + "]"), "array<double>"),
        (F.array_position(F.array(*(F.lit(c) for c in sorted(counts))), F.col("lang")) - 1).cast("int"),
    )
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = (1 + F.pmod(F.xxhash64(F.col("doc_id"), F.lit("start")), room)).cast("int")
    chosen = rows.filter(drawn < rate * (1 << 30)).select(
        F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).cast("binary").alias("bytes"), "lang", drawn.alias("drawn")
    )
    best = chosen.orderBy("drawn", "lang", "bytes").limit(SAMPLE_ROWS).collect()
    return [(bytes(r["bytes"]), r["lang"]) for r in best]


def fit(docs: DataFrame) -> Network:
    """Learn from text and language of the documents outside the held-out fold, by crc32 of the id."""
    return train(labelled_sample(docs.filter(id_remainder("doc_id", FOLDS) != HELD_OUT).select("doc_id", "text", "lang")))


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (0 to 1).

    A text that is null, empty or without letters is ``und`` with score 1. With no labelled rows to
    learn from every text is ``und``. Further columns are kept, those with a new name replaced.
    """
    frame = docs.select(*(c for c in docs.columns if c not in ("lang_pred", "score")))
    names = [*frame.columns, "lang_pred", "score"]
    with_bytes = frame.withColumn("_bytes", text_bytes())

    def run(batches):
        tables = network.tables()
        for batch in batches:
            column = batch.column("_bytes")
            texts = [v.as_buffer().to_pybytes() for v in column]
            labels, scores = [], []
            start, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size > 4_000_000 or i + 1 == len(texts):
                    some = predict_texts(texts[start : i + 1], network, tables)
                    labels += some[0]
                    scores += some[1]
                    start, size = i + 1, 0
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_bytes"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=names,
            )

    return with_bytes.mapInArrow(run, f"{ddl(frame)}, lang_pred string, score double")


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict_texts(texts: list[bytes], network: Network, tables) -> tuple[list[str], list[float]]:
    labels, scores = [UNKNOWN] * len(texts), [1.0] * len(texts)
    live = [i for i, t in enumerate(texts) if network.labels and has_letter(t)]
    if not live:
        return labels, scores
    data, starts, ends, owner = windows_of([texts[i] for i in live])
    p = network.probabilities(pool(data, starts, ends, tables)).astype(np.float64)
    weight = (ends - starts).astype(np.float64)
    total = np.zeros((len(live), p.shape[1]))
    np.add.at(total, owner, p * weight[:, None])
    total /= total.sum(axis=1, keepdims=True)
    for i, row in zip(live, total, strict=True):
        best = int(row.argmax())
        labels[i], scores[i] = network.labels[best], float(min(1.0, row[best]))
    return labels, scores
