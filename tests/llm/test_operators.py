"""Every operator on awkward rows, on an empty table and against a plain version."""

import functools
import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hindcast.llm import anchors, catalog, chosen_path, common, line_variants, mixing, nn_descent, sharding, templates, token_blocks, toxicity, warc
from hindcast.session import ship_package

WORDS = " ".join(f"w{i}" for i in range(120))
#: Null and repeated rows, null keys, empty, blank and long texts, ties, and columns named like the operators' own.
ROWS = [
    (1, WORDS, "en", "b", 1, "x"),
    (2, WORDS, "en", "b", 2, "x"),
    (2, WORDS, "en", "b", 2, "x"),
    (3, None, "en", None, 3, None),
    (4, "", None, "a", 4, "x"),
    (5, " \t\n\r ", "en", "a", 5, "x"),
    (None, WORDS, "en", "c", 6, "x"),
    (7, "one", "en", "c", 7, "x"),
    (8, "é\x0bü 漢字 " + WORDS.upper(), "en", "c", 8, "x"),
    (9, WORDS + " tail", "en", "b", 9, "x"),
    (10, "long " * 60_000, "en", "b", 10, "x"),
    (11, "same line of five words\nsame line of six words\n\nsame line of five words", "en", "b", 11, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, shard int, node string"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return common.stage(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    ship_package(spark)
    return spark.createDataFrame([], SCHEMA)


def by_key(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49408, 8192), np.array([0]), np.full(100, 7), np.array([0, 2**32 - 1, 5]), rng.zipf(1.3, 5000) % 2**31):
        ids = ids.astype(np.uint32)
        assert (token_blocks.unpack_block(token_blocks.pack_block(ids)) == ids).all()


def test_words_encode_as_texts_do():
    from tokenizers import Tokenizer

    texts = ["Don't STOP, it's 3.5km!", "naïve Σίσυφος ΟΔΟΣ é é", "<|endoftext|> a<|startoftext|>b", "", " \x1c\x85 x y ", "漢字かな 🙂 İstanbul ǅ", "x" * 3000, "a​b ﬁ Ⅷ ½"]
    plain = Tokenizer.from_file(catalog.vocabulary())
    ids, lengths = token_blocks.encode_texts(token_blocks.WordEncoder(catalog.vocabulary()), pa.array(texts), 2)
    expected = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert lengths.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_plain_characters_are_cut_as_the_vocabulary_cuts():
    from tokenizers import Tokenizer

    chars = [chr(c) for c in range(1, 0x400)]
    texts = chars + [f"a{c}1{c}{c}b" for c in chars] + ["l'homme 's 's're don't", "漢字", "12 1², ...a"]
    plain = Tokenizer.from_file(catalog.vocabulary())
    expected = [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 2]]
    encoder = token_blocks.WordEncoder(catalog.vocabulary())
    for known in (0, 100, 1 << 18):  # nothing, some and all pieces are remembered
        encoder.KNOWN = known
        assert token_blocks.encode_texts(encoder, pa.array(texts), 2)[0].tolist() == expected
        assert token_blocks.encode_texts(encoder, pa.array(["漢字", None]), 2)[1].tolist() == [len(plain.encode("漢字").ids) + 1, 1]


def test_each_piece_is_encoded_once():
    encoder = token_blocks.WordEncoder(catalog.vocabulary())
    lines, encoded = [], encoder.encoded
    encoder.encoded = lambda texts, steps: (lines.extend(texts), encoded(texts, steps))[1]
    first = token_blocks.encode_texts(encoder, pa.array(["Sun sun, SUN. (sun) moon!"]), 2)[0]
    again = token_blocks.encode_texts(encoder, pa.array(["Sun sun, SUN. (sun) moon!"]), 2)[0]
    assert sorted(p for t in lines for p in t.split("\n")) == sorted(["sun", ",", ".", "(", ")", "moon", "!"])
    assert first.tolist() == again.tolist()
    assert token_blocks.word_encoder(catalog.vocabulary()) is token_blocks.word_encoder(catalog.vocabulary())


PEAK = """
import resource, sys
import numpy as np, pyarrow as pa
from hindcast.llm import catalog, common, token_blocks
rng = np.random.default_rng(1)
words = np.array(["".join(w) for w in rng.choice(list("aeinorst"), (250_000, 7))])
texts = [" ".join(words[rng.zipf(1.15, 500) % len(words)]) + "." for _ in range(4000)]
batches = [pa.RecordBatch.from_pydict({"text": texts[k : k + 1000]}) for k in range(0, 4000, 1000)]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before, encoder = peak(), token_blocks.WordEncoder(catalog.vocabulary())
for block in common.blocks_of(iter(batches), getattr(token_blocks, "BLOCK_BYTES", 4 << 20)):
    token_blocks.encode_texts(encoder, block["text"].combine_chunks(), 2)
print(peak() - before)
"""


def test_memory_of_encoding():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", PEAK], env={**os.environ, "PYTHONPATH": os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])}, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 170  # MB; 131 measured, 209 to 240 with larger blocks, two vocabularies and all encodings at once


def test_leaks_are_looked_up_part_by_part(monkeypatch):
    item = "Which of the seven rivers that cross the plain carries the most water to the sea in spring"
    bench = templates.Benchmark([1], pa.array([item]))
    texts = pa.array([None, "x " * 50 + item, "", "clean words only " * 20, item, "y"] * 20)
    whole, sizes, hashes = bench.leaks(texts), [], common.window_hashes
    monkeypatch.setattr(common, "window_hashes", lambda of, *more: (sizes.append(len(of)), hashes(of, *more))[1])
    monkeypatch.setattr(templates, "some_rows", functools.partial(templates.some_rows, most=100))
    assert bench.leaks(texts) == whole == [{}, {0: False}, {}, {}, {0: False}, {}] * 20
    assert max(sizes) <= 100
    assert bench.leaks(pa.array([], pa.string())) == []


def test_token_files(spark, docs, none):
    path = common.scratch_folder(spark)
    token_blocks.write_token_files(docs, path, catalog.vocabulary(), 2)
    rows = sorted(token_blocks.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert [r.ids for r in rows if r.doc_id in (3, 4, 5)] == [[2]] * 3
    digest = sorted(token_blocks.read_token_files(spark, path, digest=True).collect(), key=lambda r: r.start)
    assert [r.ids_crc32 for r in digest] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows]
    file = token_blocks.read_manifest(spark, path).orderBy("start").first()
    with common.open_file(path, file.file) as source:
        whole = [i for r in rows for i in r.ids]
        assert token_blocks.BlockReader(source).span(3, 20).tolist() == whole[file.start + 3 : file.start + 23]
    assert token_blocks.token_digest(none, catalog.vocabulary(), 2).collect() == []


def plain_repeats(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for k in range(len(w) - window + 1):
            if d is not None:
                key = b" ".join(w[k : k + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if d is not None and first[b" ".join(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        out.append([d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()])
    return sorted(out, key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % anchors.PERIOD for a in anchors.COVER for b in anchors.COVER} == set(range(anchors.PERIOD))


def test_repeats(docs, none):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert by_key(anchors.without_repeats(docs, shard_bytes=4000), *columns) == plain_repeats(ROWS, 50)
    assert anchors.without_repeats(none).collect() == []


def test_repeats_on_documents(spark, small):
    docs = common.table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert by_key(anchors.without_repeats(docs, shard_bytes=50_000), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_repeats(rows, 50)


def test_pages(spark, docs):
    big, pages = "<p>" + "x" * 2000, []
    pages += [(1, "http://a/1", big, "x"), (5, None, big, "x"), (3, "a b\r\nc", big, "x"), (3, "again", big, "x"), (2, "u", None, "x"), (6, "u", "", "x"), (7, "u", "short", "x"), (8, "u", "short", "x"), (None, "u", big, "x"), (9, "u", "WARC/1.1\r\n" * 300_000, "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, kind string")
    rows = {(r.page_id, r.record_type, r.refers_to): r for r in warc.page_digests(frame).collect()}
    assert {k[:3] for k in rows} == {(1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (2, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (None, "revisit", 5)}
    assert rows[1, "revisit", 5].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert rows[1, "revisit", 5].payload_bytes == len(big) and rows[2, "response", None].payload_bytes == 0
    assert warc.page_digests(frame.limit(0)).collect() == []


def salvage(data):
    return list(warc.SalvageReader(pa.BufferReader(data)))


def test_salvage():
    members = [warc.record_bytes(i, "u", b"body %d " % i * 50, None, "2024-01-01T00:00:00Z") for i in range(5)]
    assert [r["kind"] for r in salvage(b"".join(members))] == ["response"] * 5
    damaged = bytearray(b"".join(members))
    damaged[len(members[0]) + 40] ^= 255
    found = salvage(bytes(damaged))
    assert [r["kind"] for r in found] == ["response", "gap", "response", "response", "response"]
    assert (found[1]["offset"], found[1]["length"]) == (len(members[0]), len(members[1]))
    found = salvage(b"junk" + members[0] + members[1][:-20] + members[2])
    assert [r["kind"] for r in found] == ["gap", "response", "gap", "response"]
    plain = [zlib.decompress(m, 31) for m in members]
    wrong = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert [r["kind"] for r in salvage(plain[0] + wrong + plain[2] + members[3])] == ["response", "gap", "response", "response"]
    changed = plain[1].replace(b"body 1", b"bodi 1", 1)
    found = salvage(plain[0] + changed + plain[2])
    assert [(r["kind"], r["reason"]) for r in found][1] == ("gap", "block digest")
    assert sum(r["length"] for r in found) == sum(map(len, (plain[0], changed, plain[2])))
    assert salvage(b"") == [] and [r["kind"] for r in salvage(members[0][:-1])] == ["gap"]


def test_near_duplicates(docs, none):
    rows = by_key(chosen_path.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert [1, 119, 1, True] in rows and rows.count([2, 119, 1, False]) == 2 and [9, 120, 1, False] in rows
    assert [3, 0, 3, True] in rows and [5, 0, 5, True] in rows and [7, 1, 7, True] in rows and [8, 122, 1, False] in rows
    assert [None, 119, None, True] in rows and [10, 1, 10, True] in rows and len(rows) == len(ROWS)
    assert chosen_path.near_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [5, 500_000])
def test_components(spark, monkeypatch, block):
    from hindcast.llm import components

    monkeypatch.setattr(components, "BLOCK", block)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, 3), (3, 7), (3, 3), (9, 7), (500, 400), (400, 450)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert found == {**{k: 100 for k in range(101, 141)}, 7: 3, 9: 3, 500: 400, 450: 400}


def test_nodes_too_large_for_a_task(spark):
    """Copies that no branching separates, with a limit far below their number, are still all linked."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[:k], "other%d" % k, *base[k + 1 :]])) for k in range(120)]
    rows += [(500 + k, " ".join(f"v{k}x{i}" for i in range(50))) for k in range(30)]
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), task_rows=40, most_levels=1).collect()
    assert {r.component_id for r in found if r.doc_id < 500} == {0}
    assert sum(r.kept for r in found) == 31


def near_miss_texts(n: int) -> list[tuple[int, str]]:
    """Texts that share most of their words with all others, some above and most below the threshold."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(5, 14)), replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    return rows


def plain_components(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = {k: set(zip(t.split()[:-1], t.split()[1:], strict=True)) for k, t in rows}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("task_rows, most_levels", [(8_000, 14), (30, 0)])
def test_near_misses(spark, task_rows, most_levels):
    """The closure is that of all pairs, in whole nodes as in nodes cut into blocks."""
    rows = near_miss_texts(160)
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), task_rows=task_rows, most_levels=most_levels).collect()
    plain = plain_components(rows)
    assert {r.doc_id: r.component_id for r in found} == plain
    assert 1 < len(set(plain.values())) < len(rows)


@pytest.mark.parametrize("task_rows, task_items", [(1_000, 1_000_000), (20, 4_000)])
def test_spanning_links(spark, task_rows, task_items):
    """From one node without known links: those that close it, fewer than documents a task, over blocks of any size."""
    rows = near_miss_texts(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = chosen_path.described(docs, 2).selectExpr("doc_id AS rep_id", "n_shingles", "sketch", "7L AS node", "doc_id AS label")
    links = chosen_path.spanning_links(common.stage(one), docs, 2, 80, task_rows, task_items).collect()
    label = {k: k for k, _ in rows}
    for r in links:
        low, high = sorted((label[r.a], label[r.b]))
        label = {k: low if v == high else v for k, v in label.items()}
    plain = plain_components(rows)
    assert label == plain
    if task_rows == 1_000:
        assert len(links) == len(rows) - len(set(plain.values()))


def test_faced_meets_every_unlike_pair(spark):
    rows = spark.range(200).selectExpr("id AS rep_id", "id % 2 AS node", "5L AS n_shingles", "binary('') AS sketch", "id % 7 AS label")
    met = set()
    tasks = {}
    for r in chosen_path.faced(common.stage(rows), F.lit(1), 16).collect():
        tasks.setdefault(r.node, []).append(r)
    assert max(map(len, tasks.values())) < 64
    for task in tasks.values():
        met |= {(a.rep_id, b.rep_id) for a in task for b in task if a.asks and a.label != b.label}
    unlike = {(a, b) for a in range(200) for b in range(200) if a % 2 == b % 2 and a % 7 != b % 7}
    assert all((a, b) in met or (b, a) in met for a, b in unlike)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3, 8))
    rows = [(1, x[0], 1), (2, x[0] * 3, 1), (3, x[0] + 1e-3, 1), (4, x[0], 2), (5, x[1], 1), (6, np.zeros(8), 1), (7, None, 1), (8, [None] + [1.0] * 7, 1), (9, [float("nan")] * 8, 1), (10, x[0], None), (11, [float("inf")] * 8, 1), (12, [], 1), (13, [1.0, 2.0], 1), (None, x[0], 1), (5, x[1], 1), (14, x[0] * 1e200, 1)]
    rows = [(k, None if v is None else [None if a is None else float(a) for a in v], label, "x") for k, v, label in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, sim string")
    found = by_key(nn_descent.near_vectors(frame), "vec_id", "n_links", "component_id", "kept")
    linked = {1: 3, 2: 3, 3: 3, 14: 3}
    assert found == sorted(([k, linked.get(k, 0), 1 if k in linked else k, k not in (2, 3, 14)] for k, *_ in rows), key=repr)
    assert nn_descent.near_vectors(frame.limit(0)).collect() == []


def test_saturated_lists_grow(spark):
    rng = np.random.default_rng(4)
    near = rng.standard_normal(16) + 0.01 * rng.standard_normal((90, 16))
    rows = [(k, v.tolist(), 1) for k, v in enumerate([*near, *rng.standard_normal((300, 16))])]
    found = nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf=16).collect()
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.98).sum(1) - 1
    assert sum(r.n_links for r in found) >= 0.97 * true.sum()
    assert all(r.n_links <= true[r.vec_id] for r in found)


def test_copies_of_a_vector_are_searched_once(spark):
    rng = np.random.default_rng(9)
    hot, far = rng.standard_normal((2, 16))
    rows = [(k, hot.tolist(), 1) for k in range(1000, 1400)] + [(k, (hot + 1e-3 * k).tolist(), 1) for k in (1, 2)] + [(2000, hot.tolist(), 2), (2001, far.tolist(), 1), (2002, far.tolist(), 1)]
    rows += [(5, far.tolist(), 1), (5, hot.tolist(), 3), (5, hot.tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    least = min(tuple(v / np.linalg.norm(v)) for v in (hot, far))
    in_hot = np.allclose(least, hot / np.linalg.norm(hot))  # of the rows of vector 5, the least label and vector counts
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_vectors(frame).collect()}
    group = 401 + in_hot
    assert got[1] == (group, 1, True) and got[2] == (group, 1, False) and all(got[k] == (group, 1, False) for k in range(1000, 1400))
    assert got[2000] == (0, 2000, True)
    assert got[2001] == ((1, 2001, True) if in_hot else (2, 5, False))
    classes, members = nn_descent.vector_classes(frame)
    assert classes.count() == 5 and members.count() == 406
    links, _ = nn_descent.similar_vectors(classes.select("vec_id", "label", "dim", "vec"), 0.98)
    assert links.count() == 3, "no pair of copies is a row"


def test_lines(docs, none):
    rows = {r.doc_id: r for r in line_variants.repeated_lines(docs, shard_bytes=4000).collect()}
    assert rows[11].removed_lines == [1, 3] and rows[11].n_lines == 3
    assert rows[9].removed_lines == [0] and rows[1].removed_lines == [] and rows[2].removed_lines == [0]
    assert (rows[3].n_lines, rows[4].n_lines, rows[5].n_lines, rows[None].n_removed) == (0, 0, 0, 0)
    assert line_variants.repeated_lines(none).collect() == []


def test_lines_of_shared_ids(spark):
    """Equal rows, and rows with other lines in the same place, are one document and do not remove their own lines."""
    rows = [(5, "a b c d e f\na b c d x y"), (5, "a b c d e f"), (7, "k l m n o p"), (7, "k l m n o q"), (8, "k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, tuple(r.removed_lines)) for r in line_variants.repeated_lines(docs).collect())
    assert got == [(5, 2, ()), (5, 2, ()), (7, 1, ()), (7, 1, ()), (8, 1, (0,))]


def test_lines_against_definition(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(4)):
            words = [rng.choice(["a", "b", "long" * rng.randrange(1, 30), "é"]) for _ in range(rng.randrange(8))]
            lines += [" ".join(words), "\t".join(words[:2] + words[3:])][: rng.randrange(1, 3)]
        texts.append("\n".join(lines))
    places = [(k, n, tuple(line.split())) for k, text in enumerate(texts) for n, line in enumerate(text.split("\n")) if line.split()]

    def near(a: tuple, b: tuple) -> bool:
        if a == b:
            return True
        if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    expected = {k: [] for k in range(len(texts))}
    for i, (k, n, line) in enumerate(places):
        if any(near(line, other) for _, _, other in places[:i]):
            expected[k].append(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed_lines for r in line_variants.repeated_lines(docs, shard_bytes=500).collect()}
    assert got == expected and sum(map(len, got.values())) > 50


def test_lines_judged_over_ends_of_blocks():
    names = ["v1", "v2", "at", "doc_id", "number"]
    rng = random.Random(3)
    rows = sorted({(rng.randrange(4), 0, rng.randrange(-1, 3), rng.randrange(4), rng.randrange(3)) for _ in range(90)})
    rows = [r for i, r in enumerate(rows) if r[2] >= 0 or rows[i - 1][:3] != r[:3]]  # equal lines are one
    gone = {b[3:] for a in rows for b in rows if a[:2] == b[:2] and a[3:] < b[3:] and (a[2] == b[2] or -1 in (a[2], b[2]))}
    assert 0 < len(gone) and any(r[2] == -1 for r in rows)
    for size in (1, 2, 7, len(rows)):
        blocks = [pa.table([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=names) for i in range(0, len(rows), size)]
        assert {(r["doc_id"], r["number"]) for b in line_variants.near_earlier(iter(blocks)) for r in b.to_pylist()} == gone


def test_lines_read_only_where_wanted():
    texts = pa.array(["a b c d\ne f g h", None, "a b c d\n\n i j k"])
    whole = line_variants.Lines(texts)
    some = line_variants.Lines(texts, lambda text, number: (text == 2) & (number > 0))
    assert some.text.tolist() == [2] and some.number.tolist() == [2] and some.h1[0] == whole.h1[3]
    assert whole.h1[0] == whole.h1[2] and whole.h2[0] == whole.h2[2] and len(set(whole.h1.tolist())) == 3


def test_flat_hashes():
    words = ["a" * k for k in range(1, 200)] + ["a\x00", "a\x00\x00", "ab", "ba", "é" * 5, "x" * 8 + "y" * 8, "y" * 8 + "x" * 8]
    array = pa.array([*words, *reversed(words)], pa.large_string())
    hashes = common.flat_hashes(array).tolist()
    assert hashes[: len(words)] == hashes[: len(words) - 1 : -1] and len(set(hashes)) == len(words)
    assert common.flat_hashes(array[5:9]).tolist() == hashes[5:9] and common.flat_hashes(array, 1)[0] != hashes[0]
    assert len(common.flat_hashes(array[:0])) == 0


def test_segments_against_definition():
    rng = np.random.default_rng(5)
    scores = np.where(rng.random(400) < 0.2, rng.random(400) * 4, -rng.random(400))
    offsets = np.array([0, 0, 150, 150, 400])
    found = toxicity.maximal_segments(scores, offsets)
    assert found[0] == [] and found[2] == []
    for row, (a, b) in ((1, (0, 150)), (3, (150, 400))):
        upto = np.concatenate([[0], np.cumsum(scores[a:b])])
        best = max(upto[j] - upto[i] for i in range(b - a) for j in range(i + 1, b - a + 1))
        assert max(s for s, _, _ in found[row]) == pytest.approx(best)
        for s, i, j in found[row]:
            assert s == pytest.approx(upto[j] - upto[i])
            inner = upto[i : j + 1]
            assert inner[0] < inner[1:].min() and inner[-1] > inner[:-1].max()


def test_repeated_passages_are_found():
    bad, rest = "vile foul rotten nasty", " ".join(f"plain{i} words" for i in range(40))
    model = toxicity.Model(pa.array(["vile", "foul", "rott", "nast"], pa.large_string()), np.full(4, 4.0), log_k=-1.0)
    spread = " ".join(f"{w} {rest}" for w in bad.split())
    scores, n = toxicity.rate(model, pa.array([f"{rest} {bad} {rest}", f"{bad} {rest} {bad} {rest} {bad}", f"{spread} {bad}", spread]))
    assert n == [1, 3, 1, 0] and scores[1] > scores[0]


def test_toxicity_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert toxicity.score_documents(none, toxicity.learn(none, labels.limit(0))).collect() == []


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    found = toxicity.score_documents(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = [r.predicted for r in found if r.toxic == 1]
    false = [r.predicted for r in found if r.toxic == 0]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.02


def test_templates(spark, docs, none):
    item = "A train leaves London at 9 with 120 passengers and travels 300 km before Anna boards with 120 bags of rice."
    other = "A train leaves Paris at 8 with 50 passengers and travels 400 miles before Bob boards with 50 bags of rice."
    clash = "A train leaves Paris at 8 with 50 passengers and travels 400 km before Bob boards with 51 bags"
    bench = spark.createDataFrame([(7, item), (8, None), (None, "x y z a b c"), (9, "too short"), (10, item)], "item_id long, text string")
    texts = [(1, item), (2, "so. " + other + " then"), (3, clash), (4, None), (5, ""), (6, "the train is late"), (6, item.upper())]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for pass_words in (templates.PASS_WORDS, 20):
        found = templates.with_leaks(frame, bench, pass_words=pass_words).select("doc_id", "item_ids", "changed_item_ids").collect()
        assert sorted(([*r] for r in found), key=repr)[:5] == [[1, [7, 10], []], [2, [7, 10], [7, 10]], [3, [7, 10], [7, 10]], [4, [], []], [5, [], []]]
    assert len(templates.document_leaks(docs, bench.limit(0)).where("NOT contaminated").collect()) == len(ROWS)
    assert templates.document_leaks(none, bench).collect() == []


def test_slots_must_map_consistently():
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    item = " ".join(f"{w} {n}" for w, n in zip(words, (3, 3, 4, 4, 5, 5, 6, 6)))
    bench = templates.Benchmark([1], pa.array([item]))
    same = " ".join(f"{w} {n}" for w, n in zip(words, (7, 7, 8, 8, 9, 9, 2, 2)))
    broken = " ".join(f"{w} {n}" for w, n in zip(words, (7, 1, 8, 2, 9, 4, 2, 5)))
    assert bench.leaks(pa.array([same, broken, item])) == [{0: True}, {}, {0: False}]


def test_names_by_form_and_runs(spark):
    train = "A train leaves London at 9 with 120 passengers and travels 300 km before Anna boards with 120 bags of rice."
    apples = "Tom has 5 apples. Tom buys 3 more."
    bench = spark.createDataFrame([(7, train), (8, apples)], "item_id long, text string")
    cities = "A train leaves New York City at 9 30 with 50 passengers and travels 400 miles before Bob Smith boards with 50 bags of rice."
    texts = [(1, train.upper()), (2, cities), (3, "Bob has 7 apples. Bob buys 2 more."), (4, "There is Eve. now eve has 7 APPLES and so EVE buys 2 more."), (5, "We saw Eve and Paris and Bob."),
             (6, cities.replace("New York City", "Paris").replace("Bob Smith", "Bob").upper()), (7, "Bob has apples. Bob buys more.")]
    found = templates.with_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert {r.doc_id: (r.item_ids, r.changed_item_ids) for r in found} == {1: ([7], []), 2: ([7], [7]), 3: ([8], [8]), 4: ([], []), 5: ([], []), 6: ([7], [7]), 7: ([], [])}
    short = [templates.Benchmark([1], pa.array(["We ask whether New York or Paris has more than 5 000 good old trees today."]))]
    assert short[0].leaks(pa.array(["we ask whether London or San Jose has more than 70 good old trees today"])) == [{0: True}]


def test_verbatim_passages_of_few_literals():
    items = ["Barack Obama visited New York City", "1 2 3 5 8 13 21 34 55 89 144 233 377 610", "Who wrote Hamlet?", "Der Hund jagt die Katze durch Garten, Haus, Hof, Feld, Wald und Wiese nach Bonn", "-"]
    bench = templates.Benchmark(list(range(5)), pa.array(items))
    for k, item in enumerate(items[:4]):
        assert bench.leaks(pa.array(["so it was - then " + item + " and so on", item.lower()])) == [{k: False}, {k: False}]
    half = "one two three four five six seven eight nine ten"
    bench = templates.Benchmark([1], pa.array([half]))
    assert bench.leaks(pa.array(["x one two three four five y", "x one two three four y", "Who wrote?"])) == [{0: False}, {}, {}]


def test_shards(spark, docs, none):
    rows = sharding.document_shards(docs).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    placed = sharding.feistel_shards(docs, ["doc_id", "text"], 5, 1).collect()
    counts = [sorted(r.slot for r in placed if r["shard"] == k) for k in range(5)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert sharding.document_shards(none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    numbers = spark.range(n)
    shard, slot = sharding.locate(F.col("id"), n, 3, 9)
    back = sharding.row_at(F.col("shard"), F.col("slot"), n, 3, 9)
    rows = numbers.select("id", shard.alias("shard"), slot.alias("slot")).withColumn("back", back).collect()
    assert all(r.id == r.back for r in rows)
    assert {r.slot * 3 + r["shard"] for r in rows} == set(range(n))


def test_fit():
    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = np.unique(rng.integers(0, 400, 40))
        counts = rng.integers(1, 30, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        taken = mixing.fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(budget - int((taken * lengths).sum())) <= 1
    assert mixing.fit(np.array([0, 10**9]), np.array([5, 3]), 2 * 10**9 + 5).tolist() == [0, 2]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not capped:
            return out | {s: weight[s] * level for s in open_}
        for s in capped:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= capped
    return out


def test_mix(spark, docs, none):
    rows = mixing.mix_documents(docs, cell_rows=2).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    targets = plain_targets(sizes)
    for s, size in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(targets[s]) and r.source_size == size and 0 <= r.taken <= 2 * r["size"] for r in own)
    assert len(rows) == len(ROWS) and mixing.mix_documents(none).collect() == []


def test_mix_meets_targets(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix_documents(docs).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert len({r.copies for r in own}) <= 2
