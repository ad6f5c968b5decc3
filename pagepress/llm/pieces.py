"""Merge-type SentencePiece encoding and decoding by a score-ordered agenda.

A text is normalized as the model says (a leading space mark, spaces as marks), and its characters are the
first symbols. The agenda holds every adjacent pair of symbols whose joined text is a piece, best score
first and from the left among equals. A pair that has changed since it entered is skipped when it comes up;
a merge enters the pairs with the two new neighbours. Symbols that are no piece become byte pieces, or the
unknown piece if the model has none.

No merge can cross two characters that stand side by side in no piece. Texts are split at such places, which
``_splitter`` finds from the vocabulary, so that a fragment's ids do not depend on what is around it and
are computed once per task however often the fragment occurs. Fragments remembered are bounded by
``KNOWN_CHARS``; beyond it a task starts anew. Without such places a text is one fragment.

Short fragments take their steps together: row by row the agenda's best pair is merged, in one numpy step
for all of them, and rows whose agenda is empty leave. Long ones have their agenda as a heap.

Each Arrow batch can be checked against the sentencepiece library on the spot (``check=True``). It encodes
every fragment that is new to the task, between line feeds that no piece reaches over, and decodes the ids of
every text; a block whose fragments differ is encoded by the library text by text. ``agrees`` tells whether ids
and text are equal. In a model with pieces over line feeds or white space every text is encoded by it.

No shuffle, no join: a text stays one row of one task, whatever its source or copies. Null and empty texts
have no pieces (only the begin and end ids, if asked for). Rows, repeated ones too, and further columns stay;
a column with one of the new names is replaced. An empty table stays empty.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from pagepress.llm.common import ddl

BLOCK_CHARS = 4_000_000  # of texts taken from a batch at a time, one text at least
KNOWN_CHARS = 4_000_000  # of fragments a task remembers
SHORT = 24  # fragments of so many characters at most take their steps together
MARK = "▁"
BREAK = "\n"
_NEVER = np.iinfo(np.int32).max
_AT = (1 << 32) - 1

# The library gives one replacement character for each byte that is no part of a character.
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """Pieces, ranks by descending score, and byte pieces of a merge-type model."""

    def __init__(self, raw: bytes):
        self.raw = raw
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(raw)
        trainer, normalizer = spec.trainer_spec, spec.normalizer_spec
        kinds = spec.SentencePiece
        if trainer.model_type != trainer.BPE:
            raise ValueError("a merge-type model is needed")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("only models that keep characters and white space as they are")
        rows = [(p.piece, p.score, p.type) for p in spec.pieces]
        if any(kind in (kinds.USER_DEFINED, kinds.UNUSED) for _, _, kind in rows):
            raise ValueError("models with user-defined or unused pieces are not covered")
        self.prefix = normalizer.add_dummy_prefix
        self.pieces = [piece for piece, _, _ in rows]
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(rows) if kind == kinds.NORMAL}
        scores = sorted({score for _, score, kind in rows if kind == kinds.NORMAL}, reverse=True)
        place = {score: at for at, score in enumerate(scores)}
        self.ranks = {piece: place[rows[i][1]] for piece, i in self.ids.items()}
        named = {piece: i for i, piece in enumerate(self.pieces)}
        self.begin, self.end = named.get(trainer.bos_piece), named.get(trainer.eos_piece)
        self.unknown = next(i for i, (_, _, kind) in enumerate(rows) if kind == kinds.UNKNOWN)
        self.bytes = [named[f"<0x{b:02X}>"] for b in range(256)] if trainer.byte_fallback else None
        self.byte_of = {i: b for b, i in enumerate(self.bytes or [])}
        self.unknown_text = trainer.unk_surface
        self.silent = {i for i, (_, _, kind) in enumerate(rows) if kind == kinds.CONTROL}
        self.split = _splitter(self.ids).findall
        self._codes = None
        self.fresh: list[str] = []  # fragments first met in the last block
        self.number: defaultdict[str, int] | None = None

    def normalize(self, text: str) -> str:
        return (MARK * self.prefix + text if text else text).replace(" ", MARK)

    def encode_fragment(self, text: str) -> list[int]:
        """Ids of a text that is normalized already."""
        ids: list[int] = []
        for symbol in self._merged(text) if len(text) > 1 else text:
            known = self.ids.get(symbol)
            if known is not None:
                ids.append(known)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in symbol.encode())
            else:
                ids.append(self.unknown)
        return ids

    def _merged(self, text: str) -> list[str]:
        """Symbols of one text, with the agenda as a heap of rank and place."""
        rank = self.ranks.get
        symbol = list(text)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        standing = [rank(a + b) for a, b in zip(symbol, symbol[1:], strict=False)] + [None]
        agenda = [r << 32 | at for at, r in enumerate(standing) if r is not None]
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            at = best & _AT
            if standing[at] != best >> 32:
                continue
            gone = after[at]
            joined = symbol[at] + symbol[gone]
            symbol[at], symbol[gone], standing[gone] = joined, "", None
            right = after[at] = after[gone]
            if right < n:
                before[right] = at
                r = standing[at] = rank(joined + symbol[right])
                if r is not None:
                    heappush(agenda, r << 32 | at)
            else:
                standing[at] = None
            left = before[at]
            if left >= 0:
                r = standing[left] = rank(symbol[left] + joined)
                if r is not None:
                    heappush(agenda, r << 32 | left)
        return [s for s in symbol if s]

    def decode(self, ids: list[int], *, start: bool = True) -> str:
        """Text of the ids; ``start`` says that the text begins here, where one space mark of the model goes."""
        out: list[str] = []
        run = bytearray()
        pending = start and self.prefix
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode("utf-8", "each_byte"))
                run.clear()
                pending = False
            if i in self.silent:
                continue
            piece = self.unknown_text if i == self.unknown else self.pieces[i].replace(MARK, " ")
            if pending and i != self.unknown and piece.startswith(" "):
                piece = piece[1:]
            pending = False
            out.append(piece)
        out.append(run.decode("utf-8", "each_byte"))
        return "".join(out)

    def _start(self) -> None:
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__
        self.coded: list[bytes] = []
        self.said: list[str] = []
        self.known_chars = 0

    def look_up(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's fragments; ``coded`` has their ids as bytes, ``said`` the texts they decode to."""
        if self.number is None or self.known_chars > KNOWN_CHARS:
            self._start()
        # A fragment not met before gets the next number.
        rows = [list(map(self.number.__getitem__, self.split(self.normalize(t)))) for t in texts]
        self.fresh = list(islice(self.number, len(self.coded), None))
        self.known_chars += sum(map(len, self.fresh))
        for coded, said in self.encode_fragments(self.fresh):
            self.coded.append(coded)
            self.said.append(said)
        return rows

    def differs(self, library: sentencepiece.SentencePieceProcessor) -> bool:
        """Whether the library encodes the fragments first met in the last block otherwise, or cannot be asked so."""
        between = self.encode_fragment(BREAK)
        if self.split(f"a{BREAK}{MARK}") != ["a", BREAK, MARK]:
            return True
        asked = BREAK.join(["", *(fragment.replace(MARK, " ") for fragment in self.fresh)])
        own = [array("I", self.encode_fragment(MARK)).tobytes()] if self.prefix and asked else []
        line = array("I", between).tobytes()
        for coded in self.coded[len(self.coded) - len(self.fresh) :]:
            own += [line, coded]
        return array("I", library.encode(asked)).tobytes() != b"".join(own)

    def encode_fragments(self, fragments: list[str]) -> list[tuple[bytes, str]]:
        """Ids, as bytes, and decoded text of each fragment."""
        out: list[tuple[bytes, str] | None] = [None] * len(fragments)
        by_length: dict[int, list[int]] = {}
        for i, fragment in enumerate(fragments):
            by_length.setdefault(len(fragment), []).append(i)
        self._lockstep(fragments, {n: rows for n, rows in by_length.items() if n <= SHORT}, out)
        for i, fragment in enumerate(fragments):
            if out[i] is None:
                ids = self.encode_fragment(fragment)
                out[i] = array("I", ids).tobytes(), self.decode(ids, start=False)
        return out

    def _tables(self) -> None:
        """Symbols by number (pieces, and characters of pieces), and which symbol a pair of them makes."""
        symbols = list(dict.fromkeys([*self.ids, *(c for piece in self.ids for c in piece)]))
        number = {symbol: i for i, symbol in enumerate(symbols)}
        width = len(symbols) + 1  # the last number stands for all other characters
        codes, makes = [], []
        for piece in self.ids:
            for at in range(1, len(piece)):
                left, right = number.get(piece[:at]), number.get(piece[at:])
                if left is not None and right is not None:
                    codes.append(left * width + right)
                    makes.append(number[piece])
        order = np.argsort(np.array(codes, np.int64))
        self._width = width
        self._codes = np.r_[np.array(codes, np.int64)[order], np.iinfo(np.int64).max]
        self._makes = np.r_[np.array(makes, np.int32)[order], -1].astype(np.int32)
        self._rank = np.array([self.ranks.get(s, _NEVER) for s in symbols] + [_NEVER, _NEVER], np.int32)
        self._id = np.array([self.ids.get(s, -1) for s in symbols] + [-1], np.int64)
        self._text = np.array([s.replace(MARK, " ") for s in symbols] + [""], object)
        self._of_point = np.full(0x110000, width - 1, np.int32)
        for symbol, i in number.items():
            if len(symbol) == 1:
                self._of_point[ord(symbol)] = i

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, -1 for none."""
        code = left.astype(np.int64) * self._width + right
        at = np.searchsorted(self._codes, code)
        return np.where(self._codes[at] == code, self._makes[at], -1)

    def _lockstep(self, fragments: list[str], by_length: dict[int, list[int]], out: list) -> None:
        """Fills in the fragments whose symbols all become pieces.

        All rows of a step have equally many symbols, as each step takes one from every row; fragments of
        that length join in.
        """
        if not by_length:
            return
        if self._codes is None:
            self._tables()
        longest = max(by_length)
        row = np.zeros(0, np.int64)
        symbol = np.zeros((0, longest), np.int32)
        makes = np.zeros((0, max(longest - 1, 0)), np.int32)
        for length in range(longest, 0, -1):
            if length in by_length:
                joining = by_length[length]
                points = np.frombuffer("".join([fragments[i] for i in joining]).encode("utf-32-le"), np.uint32)
                fresh = self._of_point[points].reshape(len(joining), length)
                row = np.concatenate([row, np.array(joining, np.int64)])
                symbol = np.concatenate([symbol, fresh])
                makes = np.concatenate([makes, self._pair(fresh[:, :-1], fresh[:, 1:])])
            if not len(row):
                continue
            if length > 1:
                rank = self._rank[makes]
                at = rank.argmin(axis=1)
                going = rank[np.arange(len(row)), at] != _NEVER
            else:
                at, going = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
            self._finish(row[~going], symbol[~going], out)
            row, symbol, makes, at = row[going], symbol[going], makes[going], at[going]
            if length == 1 or not len(row):
                symbol, makes = symbol[:, : length - 1], makes[:, : max(length - 2, 0)]
                continue
            each = np.arange(len(row))
            merged = makes[each, at]
            places = np.arange(length - 1)
            symbol = np.take_along_axis(symbol, places + (places > at[:, None]), axis=1)
            symbol[each, at] = merged
            places = places[:-1]
            makes = np.take_along_axis(makes, places + (places >= at[:, None]), axis=1)
            inner = at < length - 2
            makes[each[inner], at[inner]] = self._pair(merged[inner], symbol[each[inner], at[inner] + 1])
            inner = at > 0
            makes[each[inner], at[inner] - 1] = self._pair(symbol[each[inner], at[inner] - 1], merged[inner])

    def _finish(self, row: np.ndarray, symbol: np.ndarray, out: list) -> None:
        ids = self._id[symbol]
        whole = (ids >= 0).all(axis=1)
        size = 4 * symbol.shape[1]
        coded = ids[whole].astype("<u4").tobytes()
        texts = self._text[symbol[whole]].tolist()
        for k, (i, said) in enumerate(zip(row[whole].tolist(), texts, strict=True)):
            out[i] = coded[k * size : (k + 1) * size], "".join(said)


def load(path: str) -> Model:
    """A model read on the driver; tasks get its tables, a few MB of fixed size, with their code."""
    with open(path, "rb") as file:
        return Model(file.read())


def _splitter(pieces: dict[str, int]) -> re.Pattern[str]:
    """Fragments between which no piece reaches.

    Characters that stand side by side in a piece fall into one group. A fragment is a run of one group, with
    the space marks before it; pieces with a mark behind another character leave texts whole.
    """
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        return re.compile(r"(?s).+")
    group: dict[str, str] = {}

    def root(c: str) -> str:
        while group.setdefault(c, c) != c:
            c = group[c]
        return c

    for piece in pieces:
        body = piece.lstrip(MARK)
        if len(piece) > 1:
            for c in body:
                group[root(c)] = root(body[0])
    members: dict[str, list[str]] = {}
    for c in group:
        members.setdefault(root(c), []).append(re.escape(c))
    runs = [f"[{''.join(sorted(m))}]++" for m in members.values()]
    other = "".join(re.escape(c) for c in group)
    return re.compile(f"{MARK}*+(?:{'|'.join(runs)})|{MARK}++|[^{MARK}{other}]++" if runs else f"{MARK}++|[^{MARK}]++")


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, size = 0, 0
        text = batch.column("text")
        for at in range(batch.num_rows):
            length = len(text[at].as_buffer())
            if at > start and size + length > BLOCK_CHARS:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def encode(docs: DataFrame, model_path: str, *, ids: bool = True, ends: bool = True, check: bool = False) -> DataFrame:
    """The rows with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``piece_ids`` and ``agrees``.

    ``ids_sha256`` hashes the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` what they
    decode to. ``ends`` puts the begin and end ids around. A model file has a few hundred KB.
    """
    model = load(model_path)
    new = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    new |= {"piece_ids": "array<int>"} if ids else {}
    new |= {"agrees": "boolean"} if check else {}
    kept = [c for c in docs.columns if c not in new]
    frame = docs.select(*kept).withColumn("text", F.coalesce(F.col("text"), F.lit("")))

    def run(batches):
        library = sentencepiece.SentencePieceProcessor(model_proto=model.raw) if check else None
        first = array("I", [model.begin]).tobytes() if ends else b""
        last = array("I", [model.end]).tobytes() if ends else b""
        for block in _blocks(batches):
            texts = block.column("text").to_pylist()
            counts, hashed, decoded, coded, agrees = [], [], [], [], []
            found = model.look_up(texts)
            doubt = check and model.differs(library)
            for text, parts in zip(texts, found, strict=True):
                coding = first + b"".join(map(model.coded.__getitem__, parts)) + last
                said = "".join(map(model.said.__getitem__, parts))
                said = said[1:] if model.prefix and said.startswith(" ") else said
                counts.append(len(coding) // 4)
                hashed.append(hashlib.sha256(coding).hexdigest())
                decoded.append(hashlib.sha256(said.encode()).hexdigest())
                if ids:
                    coded.append(array("I", coding).tolist())
                if check:
                    same = not doubt or array("I", library.encode(text, add_bos=ends, add_eos=ends)).tobytes() == coding
                    agrees.append(same and library.decode(array("I", coding).tolist()) == said)
            columns = [pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(coded, pa.list_(pa.int32()))] if ids else []
            columns += [pa.array(agrees, pa.bool_())] if check else []
            yield pa.RecordBatch.from_arrays([*block.columns, *columns], names=[*block.schema.names, *new])

    return frame.mapInArrow(run, f"{ddl(frame)}, " + ", ".join(f"{name} {kind}" for name, kind in new.items()))


def decode(frame: DataFrame, model_path: str, column: str = "piece_ids") -> DataFrame:
    """The rows with ``decoded`` (text): what the ids stand for; null ids give an empty text."""
    model = load(model_path)
    kept = frame.drop("decoded")

    def run(batches):
        for batch in batches:
            texts = [model.decode(row or ()) for row in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{ddl(kept)}, decoded string")
