"""Class-based n-gram scoring: Brown classes found by exchange, smoothed class transitions.

A word's probability after another is P(class | class before) * P(word | class).

Classes. Exchange clustering moves one unit at a time to the class where the likelihood of the class
bigrams gains most. The units are the ``HEAD_UNITS`` most frequent words, each by itself, and
``TAIL_UNITS`` groups of all other words by their last three bytes, so every word, met or not, has a
class, and what the exchange needs has a fixed size: for each unit, how often each class stands before
and after it. A pass gathers that over all training tokens as a distributed count, as in distributed
exchange clustering (Uszkoreit and Brants, 2008): a pass works with the classes of the pass before.
The moves themselves work on the table of units by classes and stay within it, whatever the corpus.

Counts. Word counts are exact and cover all training documents. A token among the ``LOOKUP_WORDS`` most
frequent words is scored from a table that each task carries (a fixed size); the others meet their
counts in a join, a row for each document and word. A word beyond the table is rare, so no key is hot.

Smoothing. Transitions are counted with 0.5 added. In a class, a discount taken from each known word's
count (from the numbers of words met once and twice) goes to the class's unknown words together.

Words are runs of bytes other than white space (space, tab to carriage return) with A-Z lower-cased,
and each text ends with an end token, which has a class of its own. Null texts are empty. Rows with
equal ids are scored one by one; a null id has remainder 0. Without training rows N and V are 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagepress.llm.common import cut, id_remainder, text_bytes

CLASSES = 32
END = CLASSES  # the end token's class, before and after every text
HEAD_UNITS, TAIL_UNITS = 8192, 4096
LOOKUP_WORDS = 60_000
PASSES = 3
HELD_OUT, FOLDS = 1, 5
END_WORD = b"\n"  # no word holds white space
FLUSH = 200_000  # distinct words a task counts, or rows it gathers, before it hands them on


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def tail_unit(word: bytes) -> int:
    return HEAD_UNITS + zlib.crc32(word[-3:]) % TAIL_UNITS


@dataclass
class Model:
    train_tokens: int
    vocabulary: int
    discount: float
    count: dict[bytes, int] = field(default_factory=dict)  # of the most frequent words
    unit: dict[bytes, int] = field(default_factory=dict)
    classes: np.ndarray = field(default_factory=lambda: np.zeros(HEAD_UNITS + TAIL_UNITS, np.int64))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES + 1, CLASSES + 1)))
    class_tokens: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES + 1))
    class_words: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES + 1))

    def unit_of(self, word: bytes) -> int:
        unit = self.unit.get(word)
        return tail_unit(word) if unit is None else unit

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | class); a count of 0 stands for all unknown words of the class together."""
        tokens, known = self.class_tokens[classes], self.class_words[classes]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(counts > 0, (counts - self.discount) / tokens, self.discount * known / tokens)
        return np.log10(np.where(tokens > 0, p, 1.0))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.train_tokens + 0.5 * (self.vocabulary + 1)))


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(id_remainder("doc_id", FOLDS) != HELD_OUT)


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` over whole texts: counted in each task, then summed by word."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(words(value.as_buffer().to_pybytes()))
                if len(counts) > FLUSH:
                    yield _pairs(counts)
                    counts.clear()
            counts[END_WORD] += batch.num_rows
        yield _pairs(counts)

    counted = docs.select(text_bytes().alias("text")).mapInArrow(run, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
    )


def encode_units(docs: DataFrame, unit: dict[bytes, int]) -> DataFrame:
    """The unit numbers of each text's words as two-byte integers."""

    def run(batches):
        tails: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for value in batch.column(0):
                row = words(value.as_buffer().to_pybytes())
                numbers = [unit.get(w, -1) for w in row]
                for i, n in enumerate(numbers):
                    if n < 0:
                        end = row[i][-3:]
                        if end not in tails:
                            tails[end] = tail_unit(end)
                        numbers[i] = tails[end]
                out.append(np.array(numbers, dtype=np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["units"])

    return docs.select(text_bytes().alias("text")).mapInArrow(run, "units binary")


def contexts(encoded: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit how often each class stands before it, and after it. Fixed size, summed in Spark.

    Unit number ``len(classes)`` is the end token.
    """
    lookup = np.append(classes, END)
    units, width = len(lookup), 2 * (CLASSES + 1)

    def run(batches):
        total = np.zeros(units * width, np.int64)
        for batch in batches:
            parts = []
            for value in batch.column(0):
                parts += [np.frombuffer(value.as_buffer(), np.uint16), [units - 1]]
            if parts:
                row = np.concatenate([[units - 1], *parts]).astype(np.int64)
                before, after = lookup[row[:-1]], lookup[row[1:]]
                total += np.bincount(row[1:] * width + before, minlength=len(total))
                total += np.bincount(row[:-1] * width + CLASSES + 1 + after, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    summed = encoded.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    flat = np.zeros(units * width, np.int64)
    table = summed.toArrow()
    flat[table.column("place").to_numpy()] = table.column("n").to_numpy()
    both = flat.reshape(units, 2, CLASSES + 1)
    return both[:, 0], both[:, 1]


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def class_bigrams(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Counts of (class before, class)."""
    out = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(out.T, np.append(classes, END), before.astype(np.float64))
    return out


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One sweep: each unit in turn, the frequent first, moves to the class where the likelihood gains most."""
    classes = classes.copy()
    bigrams = class_bigrams(before, classes)
    left, right = before.astype(np.float64), after.astype(np.float64)
    size = left[:-1].sum(axis=1)
    order = np.argsort(-size, kind="stable")
    n = CLASSES
    for unit in order[size[order] > 0].tolist():
        own, l, r, w = classes[unit], left[unit], right[unit], size[unit]
        # Take the unit out, then see where its column, its row and the class totals gain most.
        bigrams[:, own] -= l
        bigrams[own] -= r
        np.maximum(bigrams, 0, out=bigrams)
        cols, rows = bigrams.sum(axis=0)[:n], bigrams.sum(axis=1)[:n]
        into, out = bigrams.T[:n], bigrams[:n]
        at_l, at_r = np.flatnonzero(l), np.flatnonzero(r)
        gain = (_phi(into[:, at_l] + l[at_l]) - _phi(into[:, at_l])).sum(axis=1)
        gain += (_phi(out[:, at_r] + r[at_r]) - _phi(out[:, at_r])).sum(axis=1)
        gain -= _phi(cols + w) - _phi(cols) + _phi(rows + w) - _phi(rows)
        best = int(gain.argmax())
        if gain[best] <= gain[own] + 1e-6:
            best = own
        bigrams[:, best] += l
        bigrams[best] += r
        classes[unit] = best
    return classes


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words."""
    seen = training(docs)
    counts = cut(count_words(seen))
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count("*").alias("words"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
    ).collect()[0]
    discount = total.once / (total.once + 2 * total.twice) if total.once and total.twice else 0.5
    model = Model(total.tokens, total.words, discount)
    # The most frequent words, cut between two counts so that the bound holds whatever the ties. What
    # tells where to cut is the number of words for each count; there are few different counts.
    words_with = counts.filter(F.col("word") != F.lit(END_WORD)).groupBy("n").agg(F.count("*").alias("words"))
    room, least = LOOKUP_WORDS, None
    for r in sorted(words_with.collect(), key=lambda r: -r["n"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    frequent = counts.filter(F.col("n") >= F.lit(least) if least is not None else F.lit(False))
    top = sorted(((bytes(r["word"]), r["n"]) for r in frequent.collect()), key=lambda t: (-t[1], t[0]))
    ranked = [(w, n) for w, n in top if w != END_WORD]
    model.count = dict(ranked)
    model.unit = {w: i if i < HEAD_UNITS else tail_unit(w) for i, (w, _) in enumerate(ranked)}
    found = counts.filter(F.col("word") == F.lit(END_WORD)).collect()
    end_count = found[0]["n"] if found else 0
    model.count[END_WORD] = end_count

    encoded = cut(encode_units(seen, model.unit))
    model.classes = np.arange(HEAD_UNITS + TAIL_UNITS) % CLASSES
    before, after = contexts(encoded, model.classes)
    for _ in range(PASSES):
        model.classes = exchange(before, after, model.classes)
        before, after = contexts(encoded, model.classes)
    bigrams = class_bigrams(before, model.classes)
    smooth = (bigrams + 0.5) / (bigrams.sum(axis=1, keepdims=True) + 0.5 * (CLASSES + 1))
    model.transition = np.log10(smooth)
    _class_sizes(counts, model)
    return model, counts


def _class_sizes(counts: DataFrame, model: Model) -> None:
    """Tokens and words of each class, over all words."""

    def run(batches):
        tokens, known = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            listed = [v.as_buffer().to_pybytes() for v in batch.column("word")]
            of = np.array([END if w == END_WORD else model.classes[model.unit_of(w)] for w in listed], np.int64)
            n = batch.column("n").to_numpy()
            np.add.at(tokens, of, n)
            np.add.at(known, of, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES + 1)), pa.array(tokens), pa.array(known)], names=["class", "tokens", "words"]
        )

    sums = counts.mapInArrow(run, "class bigint, tokens bigint, words bigint").groupBy("class")
    for r in sums.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        model.class_tokens[r["class"]], model.class_words[r["class"]] = r["tokens"], r["words"]


PARTS = (
    "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, "
    "word binary, class int, times bigint"
)


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(),
             pa.int32(), pa.int64()]
    columns = list(zip(*out, strict=True)) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _parts(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each text with what the task can tell, and one for each of its words beyond the lookup.

    The first kind carries its row number, after a line feed, as a word that no count has, so that the
    join deals these rows out evenly.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        text_bytes().alias("text"),
    )
    names = [p.split()[0] for p in PARTS.split(", ")]
    listed = list(model.count)
    number = {w: i for i, w in enumerate(listed)}
    counts = np.array([model.count[w] for w in listed], np.int64)
    of = np.array([END if w == END_WORD else model.classes[model.unit_of(w)] for w in listed], np.int64)
    base, emission = model.base(counts), model.emission(counts, of)
    classes, transition, end = model.classes.tolist(), model.transition, number[END_WORD]
    known_end = int(model.count[END_WORD] > 0)

    def run(batches):
        tails: dict[bytes, int] = {}
        for batch in batches:
            out: list[tuple] = []
            ids = zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "held_out")), strict=True)
            for (row_id, doc_id, held), value in zip(ids, batch.column("text"), strict=True):
                row = words(value.as_buffer().to_pybytes())
                at = np.array([number.get(w, -1) for w in row] + [end], np.int64)
                path = np.where(at >= 0, of[at], 0)
                rare: Counter[bytes] = Counter()
                for i in np.flatnonzero(at < 0).tolist():
                    word = row[i]
                    tail = word[-3:]
                    if tail not in tails:
                        tails[tail] = classes[tail_unit(tail)]
                    path[i] = tails[tail]
                    rare[word] += 1
                hit = at[at >= 0]
                score = transition[np.append(END, path[:-1]), path].sum() + emission[hit].sum()
                known = len(hit) - 1 + known_end
                out.append(
                    (row_id, doc_id, held, len(at), known, float(base[hit].sum()), float(score), b"\n%d" % row_id, None, None)
                )
                out += [(row_id, None, None, None, None, None, None, w, tails[w[-3:]], n) for w, n in rare.items()]
                if len(out) > FLUSH // 4:
                    yield _rows(out, names)
                    out = []
            yield _rows(out, names)

    return rows.mapInArrow(run, PARTS)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores of every text, base and model, as log10 probabilities."""
    parts = _parts(docs, model)
    joined = parts.join(counts.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    array = lambda values: F.from_json(F.lit("[" + ",".join(map(repr, map(float, values))) + "]"), "array<double>")
    tokens = F.get(array(model.class_tokens), F.col("class"))
    mass = F.get(array(model.class_words), F.col("class")) * model.discount
    p = F.when(tokens <= 0, 1.0).when(n > 0, (n - model.discount) / tokens).otherwise(mass / tokens)
    plain = (n + 0.5) / (model.train_tokens + 0.5 * (model.vocabulary + 1))
    summed = joined.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce(F.col("n_known"), F.when(n > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        F.sum(F.coalesce(F.col("base"), F.col("times") * F.log10(plain))).alias("base_score"),
        F.sum(F.coalesce(F.col("model"), F.col("times") * F.log10(p))).alias("score"),
    )
    return summed.drop("row_id")


def perplexity(scored: DataFrame) -> DataFrame:
    """The scored rows with ``perplexity``, 10 to the power of the mean negative score of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
