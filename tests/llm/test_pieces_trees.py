"""Pieces against the sentencepiece library; manifest and negatives against brute force."""

import hashlib
import random
import string
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pagepress.llm import merkle, negatives, pieces
from pagepress.llm.queries import PIECE_MODEL, op11_piece_ids, op12_merkle_manifest, op13_hard_negatives

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(PIECE_MODEL)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


def test_fragments_equal_the_library(model, library):
    draw = random.Random(11)
    alphabet = " ▁\n\t aabbcdeth'stré日本１2.,!\x00\x1c\x85 ---===((;;«»éя中😀​"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(50))) for _ in range(3000)]
    texts += ["", " ", "x" * 30_000, " " * 3000, "ab" * 5000, "</s><s><0x0A>", "▁▁the", "the of and " * 50]
    for text, parts in zip(texts, model.look_up(texts), strict=True):
        theirs = library.encode(text)
        assert b"".join(model.coded[p] for p in parts) == array("I", theirs).tobytes()
        assert model.decode(theirs) == library.decode(theirs)
    # One step at a time and all together give the same.
    fragments = sorted({f for t in texts for f in model.split(model.normalize(t))})
    assert [p[0] for p in model.encode_fragments(fragments)] == [array("I", model.encode_fragment(f)).tobytes() for f in fragments]
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.choice([0, 1, 2, 28705])]) for _ in range(draw.randrange(8))]
        assert model.decode(ids) == library.decode(ids)


def test_known_fragments_start_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_CHARS", 5)
    small = pieces.load(PATH)
    for text in ("one two", "two three", "one four " + "y" * 100, "two"):
        assert b"".join(small.coded[p] for p in small.look_up([text])[0]) == array("I", library.encode(text)).tobytes()


def test_check_finds_differences(library, model):
    texts = ["one two\nthree", "x\n\ny z▁▁", "…?! tail"]
    fresh = pieces.load(PATH)
    fresh.look_up(texts)
    assert not fresh.differs(library)
    fresh.coded[2] = array("I", [5]).tobytes()
    assert fresh.differs(library)
    fresh.look_up(texts)
    assert not fresh.fresh and not fresh.differs(library)


def test_piece_ids(spark, library):
    rows = [(1, None, "g"), (2, "", "g"), (3, "One line.\nTwo.", "g"), (3, "One line.\nTwo.", "g"), (None, "No id", "g"), (4, "x y" * 100_000, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = pieces.decode(pieces.encode(odd, PATH, check=True), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(r.text, add_bos=True, add_eos=True)
        assert r.agrees and r.piece_ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == sha(array("I", ids).tobytes()) and r.decoded_sha256 == sha(r.decoded)
    assert pieces.encode(odd.limit(0), PATH).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op11_piece_ids(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.agrees and (r.n_tokens, r.ids_sha256) == (len(ids), sha(array("I", ids).tobytes()))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def plain_manifest(rows):
    """(doc_id, leaf) to (subroot, root, proof, folded root), by the definition."""

    def leaf(r, text):
        values = (r.doc_id, r.source, r.lang, r.n_chars, text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {name: levels([leaf(r, r.text) for r in groups[name]]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            own = trees[name][0][i]
            crc = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
            folded = leaf(r, r.text and r.text.translate(lower)) if crc % 3 == 0 else own
            said = ""
            for tree, at in ((trees[name], i), (top, place)):
                for nodes in tree[:-1]:
                    run, k = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    said += "".join(run[:k] + run[k + 1 :])
                    folded = sha("".join([*run[:k], folded, *run[k + 1 :]]))
                    at //= 8
            out.append((r.doc_id, own, trees[name][-1][0], top[-1][0], sha(said), folded))
    return sorted(out, key=str)


def run_manifest(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    rows = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got]
    assert sorted(rows, key=str) == plain_manifest(docs.collect())


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _key int"


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(1, "s", "en", 3, "Abc", "x", 1), (1, "s", "en", 3, "Abc", "x", 1), (1, "s", "en", 3, "Abd", "x", 1), (None, None, None, None, None, None, None),
            (None, "t", None, 0, "", "x", 2), (7, "s", "ß", 9, "Ä" * 300_000, "x", 1), (8, "s", "a", 1, "Q", "x", 1)]
    rows += [(100 + i, "s", "nine", i, f"T{i}", None, i) for i in range(9)]
    rows += [(100 + i, "s", f"lang {i}", i, f"T{i}", None, i) for i in range(9)]
    run_manifest(spark, spark.createDataFrame(rows, FIELDS).repartition(3), tmp_path)


def test_manifest_of_several_rounds(spark, tmp_path, monkeypatch):
    """Blocks of 64 leaves, so that a hot group needs three rounds; the upper paths are not broadcast."""
    monkeypatch.setattr(merkle, "DIGITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    monkeypatch.setattr(merkle, "SMALL", 3)
    row = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 50 > 0, "hot").otherwise("cold").alias("lang"),
        F.col("id").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"),
    )
    run_manifest(spark, row, tmp_path)


def test_manifest_of_nothing(spark, tmp_path):
    run_manifest(spark, spark.createDataFrame([], FIELDS), tmp_path)


def plain_negatives(rows, modulus=100):
    """By the definition; rows are (vec_id, label, integers)."""
    out = []
    for a, la, qa in rows:
        if a % modulus:
            continue
        scores = [(-sum(x * y for x, y in zip(qa, q, strict=True)), v, label) for v, label, q in rows if v != a and len(q) == len(qa)]
        scores.sort()
        for s, p, _ in [x for x in scores if x[2] == la][:5]:
            hits = [(n, t) for t, n, label in scores if label != la and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("tile, block", [(8192, 2048), (40, 7)])
def test_negatives(spark, monkeypatch, tile, block):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "BLOCK", block)
    draw = np.random.default_rng(5)
    rows = [(i, int(draw.integers(0, 3)), [float(x) for x in draw.integers(-3, 4, 5) / 256]) for i in range(400)]
    rows += [(1000 + i, 1, [0.01] * 5) for i in range(100)]  # many ties
    rows += [(2000, 1, [0.02] * 5), (2100, 1, [-0.02] * 5), (2200, 2, [1e7] * 5), (2300, 9, [0.01] * 5), (3000, 1, [0.01] * 3), (3001, 1, [0.1] * 3)]
    rows += [(3002, 0, [0.05] * 3), (4000, 5, [])]
    plain = [(v, label, [int(np.floor(256 * x)) for x in e]) for v, label, e in rows]
    odd = [(5000, None, [0.1]), (5100, 1, None), (5200, 1, [0.1, None]), (5300, 1, [float("nan")] * 5), (5400, 1, [float("inf")] * 5), (None, 1, [0.1] * 5)]
    frame = spark.createDataFrame([(*r, 7, None) for r in rows + odd + rows[:5]], "vec_id long, label int, embedding array<double>, rank int, tile string")
    got = negatives.mine(negatives.integers(frame), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(plain)
    assert negatives.mine(negatives.integers(frame.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_boxes_hold_their_scores():
    """A node's interval holds the score of each row below it; large integers are multiplied exactly."""
    draw = np.random.default_rng(6)
    points, labels = draw.integers(-(2**40), 2**40, (900, 6)), draw.integers(0, 4, 900)
    tree = negatives.Tree(np.arange(900), labels, points)
    assert sorted(tree.ids.tolist()) == list(range(900)) and len(tree.levels) == 3
    anchor = draw.integers(-(2**40), 2**40, 6)
    got = tree.search(anchor, -1, 2, False, [(float("-inf"), float("inf"))], 7)[0]
    scores = sorted((-sum(int(x) * int(y) for x, y in zip(anchor, p, strict=True)), i) for i, p in enumerate(points) if labels[i] != 2)
    assert [(-s, i) for s, i in scores[:7]] == got


def test_registered_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    plain = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in rows]
    assert sorted(tuple(r) for r in op13_hard_negatives(spark, SF).collect()) == plain_negatives(plain)
