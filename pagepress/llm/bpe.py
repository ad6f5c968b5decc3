"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes the texts of its partition a block at a time. The block's distinct pieces (matches
of the split pattern) form one array of byte tokens with links to the neighbours. An inverted index
maps the rank of a token pair to the positions where the pair stands. The index is replayed in rank
order: all standing positions of the lowest rank are merged together, and only the pairs of the
touched neighbours enter the index anew. A position whose pair has changed in the meantime is
skipped when its rank comes up. Pieces are encoded once per block however often they occur.

A merge can bring up a pair of a *lower* rank within the same piece. The library this must agree
with would take that pair next, before further places of the current rank in the same piece. Where that
can happen, a step merges only the first standing place in the piece; the later places wait in the
index under the same rank and come up again after the lower rank.

No shuffle, no join: a text stays one row of one task, whatever its source or copies.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pagepress.llm.common import ddl

BLOCK_CHARS = 16_000_000
KNOWN_CHUNKS = 300_000  # chunks a task remembers between blocks; beyond it starts anew
# White space of the split pattern (the Unicode property), as a class for the plain regex module.
_SPACE = "\t-\r \x85\xa0  -     　"
# A piece never reaches from visible text over white space, so texts may be cut before white space.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a rank file (base64 and rank a line). A few hundred KB, of fixed size."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Vocabulary:
    """Ranks of tokens and of token pairs.

    A pair's rank is the rank of its joined bytes, so every split of a token into two tokens is a pair.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte < 0).any():
            raise ValueError("a byte-level vocabulary holds every single byte")
        codes, ranks = [], []
        for token, rank in self.rank.items():
            for at in range(1, len(token)):
                left, right = self.rank.get(token[:at]), self.rank.get(token[at:])
                if left is not None and right is not None:
                    codes.append(left * len(tokens) + right)
                    ranks.append(rank)
        order = np.argsort(np.array(codes, dtype=np.int64))
        self.codes = np.array(codes, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        # Per token the lowest rank of a pair that it is part of.
        self.lowest = np.full(len(tokens), len(tokens), dtype=np.int64)
        np.minimum.at(self.lowest, self.codes // len(tokens), self.ranks)
        np.minimum.at(self.lowest, self.codes % len(tokens), self.ranks)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        if not len(self.codes):
            return np.full(len(left), -1, dtype=np.int64)
        code = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)


class _Index:
    """Rank of a pair to the positions of its left token; ranks come up lowest first."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for rank, group in zip(ranks[starts].tolist(), np.split(positions, starts[1:]), strict=True):
            if rank in self.places:
                self.places[rank].append(group)
            else:
                self.places[rank] = [group]
                heapq.heappush(self.heap, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.heap)
        groups = self.places.pop(rank)
        if len(groups) == 1:
            return rank, groups[0]
        at = np.sort(np.concatenate(groups))
        return rank, at[np.r_[True, at[1:] != at[:-1]]]


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces one after another, and how many each piece has."""
    ids = np.array([vocabulary.rank.get(piece, -1) for piece in pieces], dtype=np.int64)
    counts = np.array([1 if piece else 0 for piece in pieces], dtype=np.int64)
    rest = np.flatnonzero((ids < 0) & (counts > 0))
    if not len(rest):
        return ids[counts > 0], counts
    merged, found = _replay([pieces[i] for i in rest.tolist()], vocabulary)
    counts[rest] = found
    starts = np.cumsum(counts) - counts
    flat = np.empty(counts.sum(), dtype=np.int64)
    whole = ids >= 0
    flat[starts[whole]] = ids[whole]
    flat[np.repeat(starts[rest] - (np.cumsum(found) - found), found) + np.arange(len(merged))] = merged
    return flat, counts


def _replay(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    token = vocabulary.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), lengths)
    n = len(token)
    right = np.arange(1, n + 1)
    right[np.cumsum(lengths) - 1] = -1
    left = np.arange(-1, n - 1)
    left[np.cumsum(lengths) - lengths] = -1
    alive = np.ones(n, dtype=bool)
    standing = np.full(n, -1)  # rank of the pair that begins at a position
    index = _Index()
    at = np.flatnonzero(right >= 0)
    standing[at] = vocabulary.pair_ranks(token[at], token[right[at]])
    index.add(standing[at], at)
    while index.heap:
        rank, at = index.pop()
        at = at[standing[at] == rank]
        if not len(at):
            continue
        at, later = _together(at, rank, token, piece, left, right, vocabulary)
        if len(later):
            index.add(np.full(len(later), rank), later)
        gone = right[at]
        token[at] = rank
        alive[gone] = False
        standing[gone] = -1
        standing[at] = -1
        beyond = right[gone]
        right[at] = beyond
        left[beyond[beyond >= 0]] = at[beyond >= 0]
        touched = np.sort(np.concatenate([at[beyond >= 0], left[at][left[at] >= 0]]))
        touched = touched[np.r_[True, touched[1:] != touched[:-1]][: len(touched)]]
        standing[touched] = vocabulary.pair_ranks(token[touched], token[right[touched]])
        index.add(standing[touched], touched)
    return token[alive], np.bincount(piece[alive], minlength=len(pieces))


def _together(at, rank, token, piece, left, right, vocabulary):
    """The standing places of a rank that may be merged in one step, and those that must wait.

    Of overlapping places (as in "aaa") every second one is taken, from the left. In a piece where a
    merge would bring up a pair of lower rank, only the first place is taken.
    """
    chained = np.r_[False, right[at[:-1]] == at[1:]]
    step = np.arange(len(at))
    at = at[(step - np.maximum.accumulate(np.where(chained, 0, step))) % 2 == 0]
    if vocabulary.lowest[rank] > rank:
        return at, at[:0]
    merged = np.full(len(at), rank)
    before, after = left[at], right[right[at]]
    taken_before = np.r_[False, before[1:] == right[at[:-1]]] & (before >= 0)
    lower = np.zeros(len(at), dtype=bool)
    for has, pair in (
        (before >= 0, (np.where(taken_before, rank, token[before]), merged)),
        (after >= 0, (merged, token[after])),
    ):
        new = vocabulary.pair_ranks(*pair)
        lower |= has & (new >= 0) & (new < rank)
    if not lower.any():
        return at, at[:0]
    first = np.r_[True, piece[at][1:] != piece[at][:-1]]
    waits = np.isin(piece[at], piece[at][lower]) & ~first
    return at[~waits], at[waits]


class Chunks:
    """What a task remembers of the chunks it met: ids as 32-bit integers, in decimals, and the bytes they decode to."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.decimal = [str(i) for i in range(len(vocabulary.tokens))]
        self._start()

    def _start(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.coded: list[bytes] = []
        self.said: list[str] = []
        self.raw: list[bytes] = []

    def split(self, texts: list[str]) -> list[list[int]]:
        """The numbers of the chunks of each text; afterwards all of them are known."""
        if len(self.coded) > KNOWN_CHUNKS:
            self._start()
        # A chunk not met before gets the next number.
        rows = [list(map(self.number.__getitem__, _CHUNK.findall(t))) for t in texts]
        fresh = list(islice(self.number, len(self.coded), None))
        find, number = self.vocabulary.pattern.findall, defaultdict()
        number.default_factory = number.__len__
        parts = [[number[p] for p in find(chunk)] for chunk in fresh]
        flat, counts = encode_pieces([p.encode() for p in number], self.vocabulary)
        ends = np.cumsum(counts).tolist()
        spans = list(zip([0, *ends], ends, strict=False))
        coded, flat = flat.astype(np.int32).tobytes(), flat.tolist()
        decimals, tokens = list(map(self.decimal.__getitem__, flat)), list(map(self.vocabulary.tokens.__getitem__, flat))
        codes = [coded[4 * a : 4 * b] for a, b in spans]
        says = [",".join(decimals[a:b]) for a, b in spans]
        raws = [b"".join(tokens[a:b]) for a, b in spans]
        for part in parts:
            if len(part) == 1:
                at = part[0]
                self.coded.append(codes[at])
                self.said.append(says[at])
                self.raw.append(raws[at])
            else:
                self.coded.append(b"".join([codes[at] for at in part]))
                self.said.append(",".join([says[at] for at in part]))
                self.raw.append(b"".join([raws[at] for at in part]))
        return rows


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """The token ids of each text."""
    chunks = Chunks(vocabulary)
    return [array("i", b"".join(map(chunks.coded.__getitem__, row))).tolist() for row in chunks.split(texts)]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded text, one row at least."""
    for batch in batches:
        text = batch.column("text")
        start, size = 0, 0
        for i in range(batch.num_rows):
            length = len(text[i].as_buffer() or b"")
            if i > start and size + length > BLOCK_CHARS:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def encode(docs: DataFrame, vocab_path: str, pattern: str, *, ids: bool = True) -> DataFrame:
    """The rows with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``token_ids``.

    ``decoded_sha256`` hashes the bytes that the ids decode to. Null and empty texts have no tokens.
    Further columns are kept; a column with one of the new names is replaced. Repeated rows stay.
    """
    vocabulary = Vocabulary(load_ranks(vocab_path), pattern)  # a few MB of fixed size, sent along with the code
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids
    kept = [c for c in docs.columns if c not in new]
    frame = docs.select(*kept).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    schema = f"{ddl(frame)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids

    def run(batches):
        chunks = Chunks(vocabulary)
        for block in _blocks(batches):
            columns = _columns(chunks.split(block.column("text").to_pylist()), chunks, ids)
            yield pa.RecordBatch.from_arrays([*block.columns, *columns], names=[*block.schema.names, *new])

    return frame.mapInArrow(run, schema)


def _columns(rows: list[list[int]], chunks: Chunks, ids: bool) -> list[pa.Array]:
    coded, said, raw = chunks.coded.__getitem__, chunks.said.__getitem__, chunks.raw.__getitem__
    counts, hashed, decoded = [], [], []
    for row in rows:
        decimals = ",".join(map(said, row))
        counts.append(decimals.count(",") + 1 if row else 0)
        hashed.append(hashlib.sha256(decimals.encode()).hexdigest())
        decoded.append(hashlib.sha256(b"".join(map(raw, row))).hexdigest())
    columns = [pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
    if ids:
        flat = pa.array(np.frombuffer(b"".join([b"".join(map(coded, row)) for row in rows]), np.int32))
        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat))
    return columns


def decode(frame: DataFrame, vocab_path: str, column: str = "token_ids") -> DataFrame:
    """The rows with ``decoded`` (binary): the bytes that the ids stand for; null ids give no bytes."""
    tokens = load_ranks(vocab_path)
    kept = frame.drop("decoded")

    def run(batches):
        for batch in batches:
            raw = [b"".join(tokens[i] for i in row or ()) for row in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    return kept.mapInArrow(run, f"{ddl(kept)}, decoded binary")
