"""Personal data: fixed rules, and a linear-chain conditional random field that adds spans.

The rules give spans of e-mail addresses, IP addresses, card and phone numbers. Each is written so
that it scans a text once, whatever the text holds. The field labels tokens (runs of visible
characters) by word shape. It is trained on a small table of token runs taken from a bounded sample
of the documents and labelled by the rules, and decoded by Viterbi in numpy, runs of equal length
together. A token without a digit and without ``@`` is always outside; fixing it splits the chain
exactly, so that only runs of other tokens need decoding, and whole texts cost little.

A span the field finds is added if it overlaps no rule span and passes the check of its kind. Rule
spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagepress.llm.common import ddl, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
# What counts as each kind.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE_DOCS = 4000  # documents that the labelled table is taken from, at most
SAMPLE_RUNS = 20000  # rows of the labelled table, at most
FEATURES = 4096
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_EDGE = "\"'.,;:!?()[]{}<>"
_FORBIDDEN = -1e4

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, text: str) -> bool:
    digits = _digits(text)
    if KINDS[kind] == "ip":
        parts = text.split(".")
        # Leading zeros do not count; a part of more than three digits is over 255 without a conversion.
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind] == "phone":
        return 10 <= len(digits) <= 15
    return True


def _emails(text: str) -> list[Span]:
    """Each match holds one ``@``: expand to the left as far as the last match, match the domain."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            floor = found.end()
        at = text.find("@", max(at + 1, floor))
    return out


def rule_spans(text: str) -> list[Span]:
    out = _emails(text)
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(out)


_LIVE = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def token_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold a digit or ``@``."""
    runs: list[list[tuple[int, int]]] = []
    if not _LIVE.search(text):
        return runs
    fresh = True
    for m in _TOKEN.finditer(text):
        if _LIVE.search(m.group()):
            if fresh:
                runs.append([])
            runs[-1].append(m.span())
            fresh = False
        else:
            fresh = True
    return runs


_LETTERS, _DIGITS = re.compile("[^\\W\\d_]+"), re.compile("[0-9]+")


def shape(token: str) -> str:
    """Letters become x, digits become 9; runs are shortened."""
    return _DIGITS.sub("9", _LETTERS.sub("x", token))


def _sized(token: str) -> str:
    return re.sub("[0-9]", "9", _LETTERS.sub("x", token))


def run_features(tokens: list[str]) -> np.ndarray:
    """Feature numbers of each token of a run."""
    shapes = ["<"] + [shape(t) for t in tokens] + [">"]
    rows = []
    for i, token in enumerate(tokens):
        before, own, after = shapes[i : i + 3]
        said = (
            "bias", f"s{own}", f"z{_sized(token)}", f"p{before}", f"n{after}", f"b{before}|{own}", f"a{own}|{after}",
            f"t{before}|{own}|{after}", f"f{shape(token[:1])}", f"l{shape(token[-1:])}", f"d{min(20, len(_digits(token)))}",
        )
        rows.append([zlib.crc32(s.encode()) % FEATURES for s in said])
    return np.array(rows, dtype=np.int64)


def run_labels(run: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """Label of each token of a run, from the spans that touch it."""
    out = [0] * len(run)
    for start, kind, end in spans:
        inside = [i for i, (a, b) in enumerate(run) if a < end and start < b]
        for n, i in enumerate(inside):
            out[i] = 1 + 2 * kind + (n > 0)
    return out


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties: an inside label follows its begin or inside label only."""
    moves, starts = np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        moves[:, inside] = _FORBIDDEN
        moves[[inside - 1, inside], inside] = 0
        starts[inside] = _FORBIDDEN
    return moves, starts


class Field:
    """Weights of features and label pairs."""

    def __init__(self) -> None:
        self.feature = np.zeros((FEATURES, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.penalty, self.start = _allowed()

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.feature[features].sum(axis=-2)

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi over runs of equal length: (runs, length, features) to (runs, length)."""
        emit, moves = self.scores(features), self.move + self.penalty
        best, back = emit[:, 0] + self.start, []
        for i in range(1, emit.shape[1]):
            step = best[:, :, None] + moves
            back.append(step.argmax(axis=1))
            best = step.max(axis=1) + emit[:, i]
        label = best.argmax(axis=1)
        out = [label]
        for pointers in reversed(back):
            label = pointers[np.arange(len(label)), label]
            out.append(label)
        return np.stack(out[::-1], axis=1)

    def gradient(self, features: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log-likelihood, by forward and backward sums."""
        emit, moves = self.scores(features), self.move + self.penalty
        runs, length, _ = emit.shape
        forward, backward = [emit[:, 0] + self.start], [np.zeros((runs, len(LABELS)))]
        for i in range(1, length):
            forward.append(np.logaddexp.reduce(forward[-1][:, :, None] + moves, axis=1) + emit[:, i])
        for i in range(length - 1, 0, -1):
            backward.append(np.logaddexp.reduce(moves + (emit[:, i] + backward[-1])[:, None, :], axis=2))
        backward.reverse()
        total = np.logaddexp.reduce(forward[-1], axis=1)
        marginal = np.exp(np.stack(forward, 1) + np.stack(backward, 1) - total[:, None, None])
        onehot = np.eye(len(LABELS))
        feature, move = np.zeros_like(self.feature), np.zeros_like(self.move)
        missed = marginal - onehot[gold]
        flat = np.broadcast_to(missed[:, :, None, :], (*features.shape, len(LABELS)))
        np.add.at(feature, features.reshape(-1), flat.reshape(-1, len(LABELS)))
        for i in range(1, length):
            pair = forward[i - 1][:, :, None] + moves + (emit[:, i] + backward[i])[:, None, :]
            move += np.exp(pair - total[:, None, None]).sum(axis=0)
            np.add.at(move, (gold[:, i - 1], gold[:, i]), -1.0)
        return feature, move


def train(rows: list[tuple[list[str], list[int]]], steps: int = 80, rate: float = 0.5) -> Field:
    """Fit the field to labelled runs. Long runs are cut into pieces of 16 tokens for training."""
    field = Field()
    groups: dict[int, list[tuple[np.ndarray, list[int]]]] = defaultdict(list)
    for tokens, labels in rows:
        features = run_features(tokens)
        for i in range(0, len(tokens), 16):
            gold = list(labels[i : i + 16])
            if gold[0] and gold[0] % 2 == 0:
                gold[0] -= 1
            groups[len(gold)].append((features[i : i + 16], gold))
    batches = [
        (np.stack([f for f, _ in groups[n]]), np.array([g for _, g in groups[n]])) for n in sorted(groups)
    ]
    size = max(1, sum(len(f) for f, _ in batches))
    past = [np.zeros_like(field.feature), np.zeros_like(field.move)]
    for _ in range(steps if batches else 0):
        feature, move = 1e-3 * field.feature, 1e-3 * field.move
        for features, gold in batches:
            a, b = field.gradient(features, gold)
            feature, move = feature + a / size, move + b / size
        for weight, slope, seen in ((field.feature, feature, past[0]), (field.move, move, past[1])):
            seen += slope**2
            weight -= rate * slope / (np.sqrt(seen) + 1e-8)
    return field


def labelled_table(docs: DataFrame) -> DataFrame:
    """Token runs with labels, from at most ``SAMPLE_DOCS`` documents chosen by a hash of their id."""
    total = docs.count()
    chosen = F.xxhash64(F.col("doc_id"), F.lit("labels"))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    if total > SAMPLE_DOCS:
        # Keeps about twice the bound before the exact cut, so that few rows are sorted.
        rows = rows.filter((F.pmod(chosen, F.lit(1 << 30)) / F.lit(1 << 30)) < min(1.0, 2 * SAMPLE_DOCS / total))
        rows = rows.orderBy(chosen, "text").limit(SAMPLE_DOCS)

    def run(batches):
        for batch in batches:
            tokens, labels = [], []
            for text in batch.column("text").to_pylist():
                spans = rule_spans(text)
                for r in token_runs(text):
                    tokens.append([text[a:b] for a, b in r])
                    labels.append(run_labels(r, spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))],
                names=["tokens", "labels"],
            )

    runs = rows.select("text").mapInArrow(run, "tokens array<string>, labels array<int>")
    return runs.orderBy(F.xxhash64("tokens"), "tokens").limit(SAMPLE_RUNS)


def fit(docs: DataFrame) -> Field:
    return train([(r["tokens"], r["labels"]) for r in labelled_table(docs).collect()])


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the field finds in each text and that pass the check of their kind."""
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for n, text in enumerate(texts):
        for run in token_runs(text):
            groups[len(run)].append((n, run))
    out: list[list[Span]] = [[] for _ in texts]
    for _, runs in sorted(groups.items()):
        for i in range(0, len(runs), 512):
            part = runs[i : i + 512]
            features = np.stack([run_features([texts[n][a:b] for a, b in run]) for n, run in part])
            for (n, run), labels in zip(part, field.decode(features).tolist(), strict=True):
                out[n] += _spans_of(texts[n], run, labels)
    return out


def _spans_of(text: str, run: list[tuple[int, int]], labels: list[int]) -> list[Span]:
    found, i = [], 0
    while i < len(run):
        if not labels[i]:
            i += 1
            continue
        kind, last = (labels[i] - 1) // 2, i
        while last + 1 < len(run) and labels[last + 1] == 2 + 2 * kind:
            last += 1
        start, end = run[i][0], run[last][1]
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while start < end and text[start] in _EDGE and text[start] != "(":
            start += 1
        said = text[start:end]
        whole = _emails(said) == [(0, 0, len(said))] if kind == 0 else bool(_digits(said)) and valid(kind, said)
        if whole:
            found.append((start, kind, end))
        i = last + 1
    return found


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """The rows with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (rule spans), ``base_sha256``,
    ``spans`` (rule spans and added ones, by start, then kind) and ``n_added``.

    Null and empty texts have no spans. Further columns are kept, those with a new name replaced.
    """
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    frame = docs.select(*(c for c in docs.columns if c not in new)).withColumn("text", text_or_empty())

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = []
            for text, extra in zip(texts, field_spans(texts, field), strict=True):
                base = rule_spans(text)
                added = [s for s in extra if all(s[0] >= b[2] or b[0] >= s[2] for b in base)] if extra else []
                counts = [sum(1 for s in base if s[1] == k) for k in range(len(KINDS))]
                digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                rows.append((*counts, digest, _listed(sorted(base + added)), len(added)))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return frame.mapInArrow(run, f"{ddl(frame)}, {counts}, base_sha256 string, spans string, n_added bigint")
