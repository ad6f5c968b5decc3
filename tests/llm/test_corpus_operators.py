"""Operators over the whole table against brute force, and the pipeline."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagepress.llm import langid, linededup, lm, mixing, simhash, vectors
from pagepress.llm.components import components
from pagepress.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, copy string, fp string, removed string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "c", "f", "r") for i, t, s in rows], ODD)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", None), (3, "the same line of text here", "a"), (3, "the same line of text here", "a"),
            (4, "the same line of text here\n\nother words in this line now", "b"), (None, "no id at all", "b"),
            (5, long, "b"), (6, long + " end", "b"), (7, "b a", "a"), (8, "a b", "a"), (9, "one\ntwo\none", "a")]
    return frame(spark, rows)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_removed(rows):
    """Numbers of the lines that an earlier line matches, by all pairs that share a token."""
    sets, where, out = [], {}, {}
    for doc_id, text in rows:
        for k, line in enumerate(text.split("\n")):
            tokens = {w for w in re.split(r"[\x20\x09-\x0D]+", line) if w}
            if not tokens:
                continue
            shared = Counter(j for w in tokens for j in where.get(w, ()))
            if any(9 * c >= 4 * (len(tokens) + len(sets[j])) for j, c in shared.items()):
                out.setdefault(doc_id, set()).add(k)
            for w in tokens:
                where.setdefault(w, []).append(len(sets))
            sets.append(tokens)
    return out


def near_copies(n=60):
    words = [f"word{i}" for i in range(40)]
    return [(i, " ".join([*words[: i % 30], f"new{i}", *words[i % 30 + 1 :]]), "s") for i in range(n)]


@pytest.mark.parametrize("which", ["documents", "odd", "near copies"])
def test_line_dedup(spark, odd, which):
    docs = {"documents": documents(spark), "odd": odd.filter("doc_id <> 3"), "near copies": frame(spark, near_copies())}[which]
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None))
    want = plain_removed(rows)
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect() if r.doc_id is not None}
    for doc_id, text in rows:
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want.get(doc_id, ()))
        assert (got[doc_id].text or "") == left and got[doc_id].removed == len(want.get(doc_id, ()))


def test_line_dedup_edges(spark, odd):
    rows = linededup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and all(r.text is None for r in rows if r.doc_id == 1)
    assert [r.text for r in rows if r.doc_id == 3] == ["the same line of text here"] * 2
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    plan = linededup.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def long_lines(n=24, words=120):
    """Lines of 108 common words and 12 rare ones that three lines share; every second line has a near copy."""
    common = [[f"c{(7 * i + 11 * k) % 1200}" for k in range(words - 12)] for i in range(n)]
    lines = [" ".join([*c, *(f"rare{i // 3}x{k}" for k in range(12))]) for i, c in enumerate(common)]
    copies = [line.replace("rare", "else", 1 + i % 12) for i, line in enumerate(lines) if i % 2]
    return [(i, line, "s") for i, line in enumerate([*lines, *copies, "  two\tspaces  and\x0b a \rtab ", "and a spaces tab two"])]


def test_line_dedup_long_lines(spark):
    """Lines too long for 64 bits: only near copies are candidates, and all of them."""
    docs = frame(spark, long_lines())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_removed(rows)
    lines = linededup._lines(linededup._keyed(docs).withColumn("gone", F.lit(None).cast("array<bigint>")))
    sets = linededup._with_sets(lines.withColumn("settled", F.lit(False)), linededup._rarity(linededup._keyed(docs)))
    pairs = linededup._prefix_candidates(sets).distinct()
    got = {r.doc_id: r.removed for r in linededup.dedup_lines(docs).collect()}
    assert len(want) > 10 and {k for k, v in got.items() if v} == set(want)
    assert pairs.count() == len(want)


def plain_groups(rows):
    """Smallest id reachable over pairs within three bits, comparing all pairs."""
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_simhash(spark, odd):
    for docs in (documents(spark), odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), frame(spark, near_copies())):
        rows = sorted((r.doc_id, r.text) for r in docs.collect())
        got = simhash.groups(docs).collect()
        assert {r.doc_id: r.component_id for r in got} == plain_groups(rows)
        assert {r.doc_id: r.fp % 2**64 for r in got} == {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    assert simhash.groups(odd).count() == odd.count() and simhash.groups(frame(spark, [])).count() == 0
    kept = sorted((r.doc_id is not None, r.doc_id) for r in simhash.keep_one(odd).collect())
    assert kept[0] == (False, None) and len(kept) == len(set(kept))
    assert simhash.fingerprint(b"") == 0 and simhash.shingles(b"A b") == [b"a b"]


def test_every_plan_is_complete():
    """Whatever the estimates, thresholds add up so that no pair within three bits can be missed."""
    draw = np.random.default_rng(1)
    for n in (10, 10**5, 10**9):
        bits = draw.random((200, 64)) < draw.random(64)
        both = (bits.T.astype(float) @ bits) * n / 200
        chosen = simhash.plan(both, n)
        assert sum(t + 1 for _, t in chosen) == simhash.MAX_BITS + 1
        assert len({b for g, _ in chosen for b in g}) == sum(len(g) for g, _ in chosen)


def test_components(spark):
    draw = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def test_near_vectors(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 16))
    rows = np.concatenate([base, base[:20] + 0.1 * draw.normal(size=(20, 16)), base[:5], np.repeat(base[:1], 10, 0)])
    listed = [(i, v.tolist()) for i, v in enumerate(rows)]
    listed += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None]), (204, [1e200] * 16), (205, [])]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(listed, "vec_id long, embedding array<double>")).collect()}
    u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    label = vectors.forest(len(rows), a, b)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(200, 206))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_language_model(spark, odd):
    docs = documents(spark)
    model, counts = lm.fit(docs)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = Counter()
    for i, t in text.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            seen.update([*lm.words(t), lm.END_WORD])
    total, size = sum(seen.values()), len(seen)
    rows = lm.score(docs, model, counts).collect()
    for r in rows:
        row, score, before = [*lm.words(text[r.doc_id]), lm.END_WORD], 0.0, lm.END
        for w in row:
            c = lm.END if w == lm.END_WORD else int(model.classes[model.unit_of(w)])
            score += model.transition[before, c] + float(model.emission(np.array([seen[w]]), np.array([c]))[0])
            before = c
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (size + 1))) for w in row)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(row), sum(w in seen for w in row), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.allclose(np.power(10, model.transition).sum(axis=1), 1)
    assert lm.score(odd, *lm.fit(odd)).count() == odd.count() and lm.score(docs, *lm.fit(docs.limit(0))).count() == len(rows)


def test_exchange_gains_likelihood():
    """Two languages in turn: classes come apart by language, and the likelihood only grows."""
    draw = np.random.default_rng(4)
    n = lm.HEAD_UNITS + lm.TAIL_UNITS
    classes = np.arange(n) % lm.CLASSES
    text = np.concatenate([draw.integers(0, 50, 30) + 50 * (i % 2) for i in range(200)])

    def gathered(classes):
        before, after = np.zeros((n + 1, lm.CLASSES + 1), np.int64), np.zeros((n + 1, lm.CLASSES + 1), np.int64)
        np.add.at(before, (text[1:], classes[text[:-1]]), 1)
        np.add.at(after, (text[:-1], classes[text[1:]]), 1)
        return before, after

    def likelihood(classes):
        b = lm.class_bigrams(gathered(classes)[0], classes)
        return lm._phi(b).sum() - lm._phi(b.sum(0)).sum() - lm._phi(b.sum(1)).sum()

    start = likelihood(classes)
    for _ in range(3):
        classes = lm.exchange(*gathered(classes), classes)
    assert likelihood(classes) > start and not set(classes[:50]) & set(classes[50:100])


def test_mixing(spark, odd):
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    rows = [(i, f"t{i}", "a" if i % 10 else "b") for i in range(4000)]
    mixed = mixing.mix(frame(spark, rows), weights)
    share = Counter(r.source for r in mixed.collect())
    assert abs(share["b"] / share.total() - 0.75) < 0.05 and abs(share.total() - 4000) < 300
    keys = [r.order_key for r in mixed.collect()]
    assert keys == sorted(keys) and set(Counter((r.doc_id, r.copy) for r in mixed.collect()).values()) == {1}
    assert mixing.mix(odd, target_rows=100).filter("source is null").count() > 0
    assert mixing.mix(frame(spark, [])).count() == 0


def test_poisson_steps_have_the_moments_of_their_rate():
    for rate in (0.001, 0.3, 1.0, 17.5, 699.0, 1000.0, 100_000.0):
        least, steps = mixing.poisson_steps(rate)
        mass = np.diff(steps, prepend=0.0)
        at = least + np.arange(len(steps))
        mean = (mass * at).sum()
        assert abs(mean / rate - 1) < 1e-9 and abs((mass * (at - mean) ** 2).sum() / rate - 1) < 1e-6
        assert steps[-1] == 1.0 and (mass >= 0).all()
        if rate < 700:  # the plain recursion
            p = total = math.exp(-rate)
            for k in range(least + len(steps)):
                assert k < least or abs(steps[k - least] - total) < 1e-11
                p *= rate / (k + 1)
                total += p
    assert mixing.poisson_steps(0.0)[1].tolist() == [1.0]


def test_mixing_rates_and_weights(spark, monkeypatch):
    few = frame(spark, [(i, f"t{i}", "a") for i in range(5)])
    assert abs(mixing.mix(few, target_rows=50_000).count() - 50_000) < 5 * 224
    rows = frame(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(200)])
    given = lambda *pairs: spark.createDataFrame(list(pairs), "source string, weight double")
    for weights in (given(("a", 0.0), ("b", 0.0)), given(("c", 1.0)), given(("a", -1.0)), given(("a", None), ("b", float("nan"))), given(("a", 1.0)).limit(0)):
        assert mixing.mix(rows, weights).count() == 0
    only = mixing.mix(rows, given(("a", 1.0), ("a", 0.5), ("b", -3.0)))
    assert {r.source for r in only.collect()} == {"a"} and abs(only.count() - 200) < 80
    # Too many sources to broadcast: the salted join gives the same rows.
    plain = sorted(tuple(r) for r in mixing.mix(rows).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in mixing.mix(rows).collect()) == plain


def test_mixing_moves_documents_once(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"(?<!Broadcast)Exchange (\w+)", plan)
    assert moves == ["shufflepartitionidpassthrough"] and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(ORACLE[name])
    order = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in order) for r in found.fetchall())
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == want


def test_pipeline_keeps_what_it_should(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.join(kept, "doc_id", "left_anti").collect()}
    plain = {r.doc_id for r in docs.filter("text is null or not text rlike '\\\\p{L}'").collect()}
    assert plain <= gone and len(gone - plain) <= 1
    lines = stages["lines"](spark, kept, SF)
    want = plain_removed(sorted((r.doc_id, r.text) for r in kept.collect()))
    for r in lines.join(kept.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
        left = "\n".join(x for k, x in enumerate(r.old.split("\n")) if k not in want.get(r.doc_id, ()))
        assert r.text == left and r.n_chars == len(left)
    single = stages["near_duplicates"](spark, lines, SF)
    groups = plain_groups(sorted((r.doc_id, r.text) for r in lines.collect()))
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))
    mixed = stages["mixing"](spark, single, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(groups.values())
    out = stages["tokens"](spark, mixed, SF)
    assert out.count() == mixed.count() and langid.UNKNOWN not in out.columns
    assert corpus_pipeline.run(spark, SF).count() == out.count()
