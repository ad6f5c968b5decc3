"""Operators on single texts against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagepress.llm import bpe, chat, langid, pii, syncmers
from pagepress.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, gap string, spans string, n_tokens string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows and ids, clashing column names, and a very long text."""
    rows = [(1, None), (2, ""), (3, "One line.\nTwo."), (3, "One line.\nTwo."), (None, "No id"), (4, "x" * 300_000),
            (5, "mail a.b@c.org call +1 (234) 555-6789 or 10.0.0.1, card 4111 1111 1111 1111"), (6, "%% 12 !!")]
    return spark.createDataFrame([(i, t, None, "g", "s", "n") for i, t in rows], ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_bpe_equals_tiktoken(spark, odd, empty):
    path = public_tokenizers.path(VOCABULARY)
    tokens = bpe.load_ranks(path)
    vocabulary = bpe.Vocabulary(tokens, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})
    draw = random.Random(1)
    texts = ["".join(draw.choice(" \n\t aabbcd'stré日本１2.,!\x1c\x85 ") for _ in range(draw.randrange(60))) for _ in range(500)]
    texts += ["", "a" * 3000, " " * 500, "ab" * 2000, "<|endoftext|>"]
    got = bpe.encode_texts(texts, vocabulary)
    assert got == [library.encode_ordinary(t) for t in texts]
    for frame in (documents(spark).select("doc_id", "text"), odd):
        for r in bpe.decode(bpe.encode(frame, path, public_tokenizers.PATTERN), path).collect():
            ids = library.encode_ordinary(r.text)
            assert r.token_ids == ids and bytes(r.decoded).decode() == r.text and r.n_tokens == len(ids)
            assert r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(r.text)
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def plain_anchors(text):
    """Closed syncmers by the definition."""
    points = syncmers.code_points(text)
    inner = [syncmers.anchors(points[i : i + syncmers.K])[0] for i in range(len(points) - syncmers.K + 1)]
    return [i for i, found in enumerate(inner) if len(found)]


def test_syncmers_are_context_free(monkeypatch):
    draw = random.Random(2)
    text = "".join(draw.choice("abcdefgh é") for _ in range(3000))
    at, hashes = syncmers.anchors(syncmers.code_points(text))
    assert at.tolist() == plain_anchors(text) and np.diff(at).max() <= syncmers.K - syncmers.S + 1
    monkeypatch.setattr(syncmers, "CHUNK", 100)
    again = syncmers.anchors(syncmers.code_points(text))
    assert again[0].tolist() == at.tolist() and again[1].tolist() == hashes.tolist()


def test_edited_pairs(spark, odd, empty):
    for frame in (documents(spark), odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()), reverse=True)
        got = {r.doc_id: r for r in syncmers.edited_pairs(frame).collect()}
        assert len(got) == len(rows)
        for i, (doc_id, text) in enumerate(rows):
            following, n = rows[(i + 1) % len(rows)][1], len(text)
            edited = text[: n - n // 3] + following[: n // 3]
            r = got[doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, sha(edited))
            assert r.fingerprint == syncmers.fingerprint(text) and r.edited_fingerprint == syncmers.fingerprint(edited)
            assert r.near_edited == syncmers.likeness(r.fingerprint, r.edited_fingerprint)
            assert r.near_next == syncmers.likeness(r.fingerprint, syncmers.fingerprint(following))
    assert syncmers.edited_pairs(odd).count() == odd.count()
    assert syncmers.edited_pairs(empty).count() == 0


def test_rule_spans_equal_plain_patterns():
    draw = random.Random(3)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        text = "".join(draw.choice("11223.. -+@@aé()") for _ in range(draw.randrange(40)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(plain.values()) for m in re.finditer(p, text)
                      if pii.valid(k, m.group()))
        assert pii.rule_spans(text) == want
    assert pii.rule_spans("1" * 200_000 + "a@" * 50_000) == []


def test_personal_data(spark, odd, empty):
    field = pii.fit(documents(spark))
    rows = {r.doc_id: r for r in pii.find(odd.drop("spans"), field).collect()}
    assert (rows[5].n_email, rows[5].n_ip, rows[5].n_phone) == (1, 1, 1) and rows[1].spans == ""
    for r in pii.find(documents(spark), field).collect():
        base = pii.rule_spans(r.text)
        assert r.base_sha256 == sha(pii._listed(base)) and set(pii._listed(base).split(",")) <= set(r.spans.split(",")) | {""}
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_viterbi_equals_brute_force():
    from itertools import product

    field = pii.Field()
    draw = np.random.default_rng(4)
    field.feature, field.move = draw.normal(size=field.feature.shape), draw.normal(size=field.move.shape)
    features = draw.integers(0, pii.FEATURES, (3, 3, 5))
    emit, moves = field.scores(features), field.move + field.penalty
    for row, got in zip(emit, field.decode(features), strict=True):
        best = max(product(range(len(pii.LABELS)), repeat=3), key=lambda p: field.start[p[0]] + sum(row[i, x] for i, x in enumerate(p))
                   + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got) == best


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = langid.fit(docs)
    rows = langid.predict(docs, network).filter("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    got = [(r.text, r.lang_pred) for r in langid.predict(odd, network).collect()]
    assert all((p == "und") == (not any(c.isalpha() for c in t or "")) for t, p in got)
    none = langid.predict(odd, langid.fit(empty))
    assert {r.lang_pred for r in none.collect()} == {"und"} and langid.predict(empty, network).count() == 0


def test_windows_cover_every_byte():
    network = langid.Network(["a", "b"])
    data = bytes(np.random.default_rng(5).integers(0, 256, 1000, dtype=np.uint8))
    all_bytes, starts, ends, owner = langid.windows_of([data, b"", b"xy"])
    pooled = langid.pool(all_bytes, starts, ends, network.tables())
    for row, a, b in zip(pooled, starts, ends, strict=True):
        want = [max(sum(f[j][all_bytes[t + j]][k] for j in range(w)) for t in range(a, b))
                for w, f in zip(langid.WIDTHS, network.filters, strict=True) for k in range(langid.FILTERS)]
        assert np.allclose(row, want, atol=1e-5)
    assert (ends - starts).sum() == 1002 and owner.tolist() == [0, 0, 0, 0, 2]


def test_loss_text_comes_from_the_mask(spark):
    rows = [(1, 0, "user", "é</s>q"), (1, 1, "assistant", "a [INST] b"), (1, 2, "assistant", ""), (1, 3, "assistant", "😀c")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    (own,) = chat.digests(formatted).collect()
    assert own.loss_sha256 == sha("a [INST] b😀c")
    turned = F.transform("loss_mask", lambda r: F.struct(r.chars.alias("chars"), (~r.loss).alias("loss")))
    (other,) = chat.digests(formatted.withColumn("loss_mask", turned)).collect()
    assert other.turns_sha256 == own.turns_sha256
    assert other.loss_chars == sum(len(f"<|turn|>{who}\n</s>\n") for _, _, who, _ in rows) + len("é</s>q")


def test_chat_round_trip(spark):
    draw = random.Random(6)
    marks = ["<", "[", "\\", "/", "s>", "INST]", "SYS>>", "|turn|>", "\n", "</s>\n", "é", "a", "<|turn|>", "]", ">", "<<SYS>>"]
    rows = [(i // 3, draw.randrange(3), draw.choice(["user", "assistant", "sys\ntem</s>", None]),
             draw.choice([None, "", "".join(draw.choice(marks) for _ in range(draw.randrange(25)))])) for i in range(900)]
    rows += [(None, None, None, None), (1000, 0, "assistant", "w" * 200_000), (1000, 0, "assistant", "w" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    source = {}
    for conv, turn, role, text in rows:
        source.setdefault(conv, []).append((turn, role or "", text or ""))
    formatted = chat.format_conversations(frame)
    got = chat.digests(formatted).collect()
    assert len(got) == len(source)
    for r in got:
        turns = sorted(source[r.conv_id], key=lambda t: (t[0] is not None, t[0] or 0, t[1:]))
        loss = "".join(t for _, who, t in turns if who == "assistant")
        assert r.identical and r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{who}\n{t}\n" for _, who, t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    for r in formatted.collect():
        at, masked = 0, ""
        for run in r.loss_mask:
            masked += r.formatted[at : at + run.chars] if run.loss else ""
            at += run.chars
        assert at == len(r.formatted) and not re.search(r"</?s>|\[/?INST\]", masked)
    assert chat.digests(chat.format_conversations(frame.filter("conv_id = -1"))).count() == 0
