"""Pieces, spelling forms and whitening: awkward rows, empty tables and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from hindcast.llm import catalog, common, pieces, spelling, whitening
from hindcast.session import ship_package

MODEL = catalog.vocabulary(catalog.PIECES)
TEXTS = [None, "", " ", "  two  spaces ", "a", "▁ literal ▁▁", "line\n\ttab\r\n", "漢字かな 🙂 é é \x00", "<s> </s> <0x41> <unk>", "same text", "same text", "word " * 30_000, "x" * 5000]
SCHEMA = "doc_id long, text string, ids string, n long, word string"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = [(i if i != 4 else None, t, "x", 1, None) for i, t in enumerate(TEXTS)]
    return common.stage(spark.createDataFrame([*rows, rows[-1]], SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    ship_package(spark)
    return spark.createDataFrame([], SCHEMA)


def test_agenda_merges_as_the_library_does():
    encoder, library = pieces.PieceEncoder(MODEL), SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    parts = [" ", "  ", "▁", "\n", "a", "th", "the", "ing", "é", "漢", "\x00", "<s>", "<0x41>", "🙂", "A", "1", "́", "　", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 80]))) for _ in range(3000)]
    counts, ids = encoder.encode(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library.encode(texts)
    for text in texts[:300]:  # the heap for long chunks gives the same
        if text:
            assert encoder.merger.merge_long("▁" + text.replace(" ", "▁")) == library.encode(text)


def test_a_difference_from_the_library_ends_the_job():
    encoder = pieces.PieceEncoder(MODEL)
    with pytest.raises(ValueError, match="differ"):
        encoder.check(["▁the"], np.array([1]), np.array([5]))


def test_forgotten_chunks_are_merged_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    encoder = pieces.PieceEncoder(MODEL)
    assert [encoder.encode(["one two three four five"])[1].tolist() for _ in range(3)] == [SentencePieceProcessor(model_file=MODEL).encode("one two three four five")] * 3


def test_pieces(docs, none):
    library = SentencePieceProcessor(model_file=MODEL)
    expected = []
    for row in docs.collect():
        ids = [*library.encode(row.text or ""), 2]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expected.append((row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, pieces.piece_digest(docs, MODEL, 2).collect()), key=repr) == sorted(expected, key=repr)
    assert pieces.piece_digest(none, MODEL, 2).collect() == []


def test_ids_and_texts_as_columns(docs, none):
    library = SentencePieceProcessor(model_file=MODEL)
    coded = pieces.with_ids(docs, MODEL, 2)
    assert coded.columns == ["doc_id", "text", "n", "word", "ids"]  # the string column ids is replaced
    for row in pieces.with_texts(coded, MODEL, text="back").collect():
        assert row.ids == [*library.encode(row.text or ""), 2]
        assert row.back == library.decode(row.ids)
    assert pieces.with_ids(none, MODEL, 2).collect() == []


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_forms(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def test_spelling(spark, none):
    ship_package(spark)
    rng = random.Random(5)
    base = ["spelling", "variante", "naïvetés", "grouping", "aaaaaaa", "aaaaaaaa", "abababab", "élégance", "×÷letters"]
    rows = [(None, None), (1, ""), (2, "short a b c"), (None, "spelling spelling"), (7, "SPELLING Spelling " * 400)]
    for k in range(150):
        words = []
        for _ in range(40):
            w = list(rng.choice(base))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "e", "ée", "q"])
            words.append("".join(w))
        rows.append((k, " ".join(words)))
    rows += [(3, "chainaa " * 3 + "chainaab " * 40 + "chainaabc " * 500), (4, "tiesone " * 20 + "tiestwo " * 20 + "tiesooo " * 2)]
    rows.append(rows[-1])
    frame = spark.createDataFrame([(d, t, "x", 1, "clash") for d, t in rows], SCHEMA)
    found = spelling.spelling_forms(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = plain_forms(rows)
    assert sorted(map(tuple, found), key=repr) == expected
    assert any(r[2] not in (r[0], r[1]) for r in expected), "a chain of two forms is wanted"
    assert spelling.spelling_forms(none).collect() == []


def test_signatures_miss_no_pair(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([7, 8]))) for _ in range(900)})
    found = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    assert sorted((r.a, r.b) for r in found) == [(a, b) for a in words for b in words if a < b and one_edit(a, b)]


def plain_whitening(vectors, k):
    x = np.array([np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    keep = e[:k] > 1e-12 * e[0]
    return n, ((n * x - s) ** 2).sum(axis=1), e[:k][keep], axes[:, :k][:, keep], (n * x - s) / n, e.sum()


def check_whitening(rows, vectors, k=16):
    n, deviation, e, axes, centred, trace = plain_whitening(vectors.values(), k)
    keys, found = list(vectors), {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9
        assert r.deviation == deviation[keys.index(r.vec_id)]
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
    assert {v: sorted(c) for v, c in found.items()} == {v: list(range(1, len(e) + 1)) for v in keys}
    ours = np.array([[found[v][c + 1].whitened for c in range(len(e))] for v in keys])
    return ours, centred @ axes / np.sqrt(e)


def test_whitening(spark):
    ship_package(spark)
    rng = np.random.default_rng(2)
    mixing = rng.standard_normal((24, 24)) * np.geomspace(3, 0.05, 24)
    vectors = {int(i): (rng.standard_normal(24) @ mixing.T).tolist() for i in range(400)}
    vectors.update({1000 + i: vectors[7] for i in range(150)})  # copies count once in the fit
    bad = [(5000, None), (5001, []), (5002, [None] + [0.5] * 23), (5003, [float("nan")] * 24), (5004, [float("inf")] + [0.0] * 23), (5005, [1.0, 2.0])]
    rows = [(k, v, 1, 7) for k, v in [*vectors.items(), *bad]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, x int").repartition(5)
    ours, plain = check_whitening(whitening.whitened(frame).collect(), vectors)
    signs = np.sign((ours * plain).sum(axis=0))
    assert np.abs(ours - plain * signs).max() < 1e-8


def test_whitening_finds_equal_and_missing_variances(spark):
    ship_package(spark)
    axes = np.concatenate([np.eye(6)[:5], -np.eye(6)[:5]]) * 2.0  # five equal variances and one of zero
    vectors = {i: v.tolist() for i, v in enumerate(axes)}
    frame = spark.createDataFrame([(k, v) for k, v in vectors.items()], "vec_id long, embedding array<float>")
    ours, _ = check_whitening(whitening.whitened(frame).collect(), vectors)
    assert ours.shape[1] == 5
    assert np.abs(ours.T @ ours / len(ours) - np.eye(5)).max() < 1e-9


def test_whitening_without_variance(spark):
    ship_package(spark)
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(frame(rows)).collect() == []
    two = whitening.whitened(frame([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (None, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id is None, r.component, r.n, round(abs(r.whitened), 9)) for r in two) == [(False, 1, 2, 1.0), (True, 1, 2, 1.0), (True, 1, 2, 1.0)]
    with pytest.raises(Exception, match="beyond"):
        whitening.whitened(frame([(1, [1e30, 0.0]), (2, [0.0, 0.0])])).collect()


def test_whitening_of_a_query_table(spark, small):
    table = common.table(spark, small, "embeddings")
    vectors = {r.vec_id: r.embedding for r in table.collect() if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all()}
    ours, plain = check_whitening(catalog.op11_whitening(spark, small).collect(), vectors)
    # Close variances share a plane: compare what a rotation leaves alone.
    assert np.abs(ours.T @ ours - plain.T @ plain).max() < 1e-3 or np.abs(np.abs(ours) - np.abs(plain)).max() < 1e-6
