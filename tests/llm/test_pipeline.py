"""The pipeline against plain versions of its stages, each judged on the input it got."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from hindcast.llm import catalog, common, mixing, toxicity
from hindcast.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    """What each stage got and returned."""
    ship_package(spark)
    docs, out = common.table(spark, small, "documents"), []
    for _, step in pipeline.STAGES:
        made = common.stage(step(spark, docs, small))
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_columns_and_rows(stages):
    for before, after in stages[:-1]:
        assert after.columns == COLUMNS
    for before, after in stages[:3]:
        assert not rows(after) - rows(before)


def test_toxic_documents_go(spark, small, stages):
    docs, kept = stages[0]
    scored = toxicity.score_documents(docs, toxicity.learn(docs, common.table(spark, small, "labels")))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}


def test_one_of_each_group_stays(stages):
    docs, kept = stages[1]
    sets = {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    assert sorted(r.doc_id for r in kept.collect()) == [d for d in ids if root(d) == d]


def test_benchmark_passages_go(spark, small, stages):
    docs, kept = stages[2]
    split = lambda t: [w.strip(".,!?").lower() for w in (t or "").split()]
    windows = {tuple(w[k : k + 13]) for w in (split(r.text) for r in common.table(spark, small, "benchmark").collect()) for k in range(len(w) - 12)}
    leaked = {r.doc_id for r in docs.collect() if any(tuple(w[k : k + 13]) in windows for w in [split(r.text)] for k in range(len(w) - 12))}
    stay = {r.doc_id for r in kept.collect()}
    assert leaked and not leaked & stay
    assert stay == {r.doc_id for r in docs.collect()} - leaked


def test_mix_repeats_documents(stages):
    docs, kept = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(docs).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for d, n in copies.items() if n})


def test_token_files_hold_the_mix(stages):
    from tokenizers import Tokenizer

    docs, made = stages[4]
    plain = Tokenizer.from_file(catalog.vocabulary())
    ids = [(r.doc_id, np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [catalog.END_ID], "<u4")) for r in docs.collect()]
    assert Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in made.collect())
    ordered = sorted(made.collect(), key=lambda r: r.start)
    assert [r.start for r in ordered] == (np.cumsum([r.n_tokens for r in ordered]) - [r.n_tokens for r in ordered]).tolist()
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)


def test_empty_table(spark, small):
    docs = common.table(spark, small, "documents").limit(0)
    for _, step in pipeline.STAGES:
        docs = common.stage(step(spark, docs, small))
    assert docs.collect() == []
