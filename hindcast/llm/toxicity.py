"""Toxic passages as maximal scoring segments of token log-odds.

Token scores are log-odds between toxic and clean labelled rows under nested Dirichlet priors: the prior of
a word's first letters is their frequency in the whole corpus, and a longer beginning or the whole word gets
its share of the prior of the shorter one. What a word's own counts don't tell, its beginning tells.
Every score is brought towards zero by its standard error and lowered by a drift, so that clean text
falls; a linear scan then finds all maximal segments. Their scores are calibrated by an extreme-value law
fitted to clean rows, and a document's score follows from the p-value of its significant passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import stage

#: Labelled rows that are learned from, at most; those with the smallest hashes of their identifier.
SAMPLE_ROWS = 20_000
#: Words and beginnings with scores of their own, at most; the most frequent ones of the sample.
VOCABULARY = 250_000
#: Letters of the beginnings that are scored; longer words are also scored whole.
LEVELS = (4, 5, 6, 7)
#: Strength of the priors in documents: so many and a share of the sample; documents that a word needs to be
#: scored apart from its beginning.
PRIOR_ROWS, PRIOR_SHARE, LEAST_COUNT = 10.0, 0.03, 3
#: Subtracted from every token's score, and the standard errors that a log-odds loses.
DRIFT, ERRORS = 1.0, 1.0
#: A standard Gumbel variable's median, and how far its 0.9 quantile lies above that.
GUMBEL_MEDIAN, GUMBEL_SPREAD = 0.36651, 1.88386


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, word codes and distinct words: lower case, without punctuation around them."""
    offsets, words = common.split_words(texts)
    bare = pc.replace_substring_regex(pc.utf8_lower(words.dictionary), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    bare = bare.dictionary_encode()
    codes = bare.indices.to_numpy()[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    return offsets, codes, bare.dictionary


def beginnings(words: pa.Array, level: int) -> pa.Array:
    """The first ``level`` letters; 0: the whole word. Null for words that a shorter level has whole."""
    long_enough = pc.greater_equal(pc.utf8_length(words), level or LEVELS[-1] + 1)
    if level == LEVELS[0]:
        return pc.utf8_slice_codeunits(words, 0, level)
    return pc.if_else(long_enough, pc.utf8_slice_codeunits(words, 0, level) if level else words, None)


def sampled_labels(labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` labelled rows that are not held out: doc_id, toxic, and whether they calibrate."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(7))
    return one.orderBy(order, "doc_id").limit(sample_rows).withColumn("calibrates", F.pmod(order, F.lit(6)) == 0)


def held_out(doc_id):
    """Rows whose labels nothing is learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@dataclass
class Model:
    terms: pa.Array
    scores: np.ndarray
    #: Of the extreme-value law, and the p-value at which a document's score is one half.
    decay: float = 1.0
    log_k: float = 0.0
    log_alpha: float = float(np.log(1e-3))

    def token_scores(self, distinct: pa.Array) -> np.ndarray:
        """The score of each distinct word: its own, that of its longest known beginning, or an unknown word's."""
        out = np.full(len(distinct), -DRIFT)
        for level in (*LEVELS, 0):
            at = pc.fill_null(pc.index_in(beginnings(distinct, level), value_set=self.terms, skip_nulls=True), -1).to_numpy()
            out[at >= 0] = self.scores[at[at >= 0]] - DRIFT
        out[pc.equal(distinct, "").to_numpy(zero_copy_only=False)] = -DRIFT
        return out

    def level(self, n: int) -> float:
        """The best score of a clean document of ``n`` words, less its noise."""
        return float((self.log_k + np.log(max(n, 1))) / self.decay)

    def log_p(self, segments: list[float], n: int) -> float:
        """Log p-value of a document of ``n`` words: the excess of its significant passages together.

        A passage is significant where it exceeds the score that a clean document of this length reaches
        at best on average; without one, the best passage counts.
        """
        level = self.level(n)
        excess = [s - level for s in segments]
        x = sum(e for e in excess if e > 0) or max(excess, default=-level)
        e_value = np.exp(min(50.0, -self.decay * x))
        return float(np.log(-np.expm1(-e_value))) if e_value > 1e-12 else float(-self.decay * x)

    def score(self, segments: list[float], n: int) -> float:
        return float(1 / (1 + np.exp(np.clip(self.log_p(segments, n) - self.log_alpha, -500, 500))))


def maximal_segments(scores: np.ndarray, offsets: np.ndarray) -> list[list[tuple[float, int, int]]]:
    """All maximal scoring segments (score, first word, word after the last) of every row, in linear time.

    Only words with a positive score are looked at one by one; cumulative sums cover what lies between.
    Every segment on the list begins where the cumulative sum is lower than at any later beginning that
    could join it.
    """
    out: list[list[tuple[float, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(scores > 0)
    rows = np.searchsorted(offsets, places, side="right") - 1
    held: list[tuple[float, float, int, int]] = []
    row = -1

    def close() -> None:
        if row >= 0:
            out[row] = [(r - l, a - int(offsets[row]), b - int(offsets[row])) for l, r, a, b in held]

    for at, own, low, high in zip(places.tolist(), rows.tolist(), upto[places].tolist(), upto[places + 1].tolist(), strict=True):
        if own != row:
            close()
            held, row = [], own
        new = (low, high, at, at + 1)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= new[0]:
                j -= 1
            if j < 0 or held[j][1] >= new[1]:
                held.append(new)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    close()
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior_toxic: np.ndarray, prior_clean: np.ndarray, totals: tuple[float, float]) -> np.ndarray:
    """Log-odds of counts under Dirichlet priors, less their standard error, never across zero."""
    a, b = toxic + prior_toxic, clean + prior_clean
    delta = np.log(a / totals[0]) - np.log(b / totals[1])
    error = np.sqrt(1 / a + 1 / b)
    return np.sign(delta) * np.maximum(0, np.abs(delta) - ERRORS * error)


def corpus_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Occurrences of the shortest beginnings in all documents (kind 0), and in how many fitted rows each term
    occurs (kind 1); the empty term counts the rows. One pass, added up per block before the shuffle."""
    schema = pa.schema([("kind", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def counted(kind: int, terms: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), kind, np.int32)), terms.cast(pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks_of(batches):
            offsets, codes, words = normal_words(block["text"].combine_chunks())
            toxic = block["toxic"].combine_chunks().fill_null(-1).to_numpy()
            shortest = beginnings(words, LEVELS[0]).dictionary_encode()
            every = np.bincount(codes, minlength=len(words))
            size = len(shortest.dictionary)
            occurrences = np.bincount(shortest.indices.to_numpy(), weights=every, minlength=size).astype(np.int64)
            yield counted(0, shortest.dictionary, occurrences, np.zeros(size, np.int64), np.zeros(size, np.int64))
            rows = common.row_of(offsets)
            known = toxic[rows] >= 0
            labels = [(toxic == k).sum() for k in (1, 0)]
            if sum(labels):
                yield counted(1, pa.array([""]), np.array([sum(labels)]), np.array([labels[0]]), np.array([labels[1]]))
            rows, of_row = rows[known], codes[known]
            for level in (*LEVELS, 0):
                encoded = beginnings(words, level).dictionary_encode()
                of = encoded.indices.fill_null(-1).to_numpy()[of_row] if len(of_row) else of_row
                size = len(encoded.dictionary) + 1
                row, term = np.divmod(np.unique(rows[of >= 0] * np.int64(size) + of[of >= 0]), size)
                by = [np.bincount(term[toxic[row] == k], minlength=size) for k in (1, 0)]
                seen = np.flatnonzero(by[0] + by[1])
                if len(seen):
                    yield counted(1, encoded.dictionary.take(pa.array(seen)), (by[0] + by[1])[seen], by[0][seen], by[1][seen])

    fitted = F.broadcast(sample.where("NOT calibrates").select("doc_id", "toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.join(fitted, "doc_id", "left").select("text", "toxic").mapInArrow(count, "kind int, term string, n long, toxic long, clean long")
    return counted.groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_scores(docs: DataFrame, sample: DataFrame) -> Model:
    """Scores of the sample's frequent terms; at most ``VOCABULARY`` rows are gathered."""
    counts = stage(corpus_counts(docs, sample))
    totals = counts.where("kind = 1 AND term = ''").first()
    n1, n0 = (float(totals.toxic), float(totals.clean)) if totals else (0.0, 0.0)
    if not (n1 and n0):  # one class only: nothing tells toxic from clean
        return Model(pa.array([], pa.large_string()), np.zeros(0))
    corpus = counts.where("kind = 0").select("term", F.col("n").alias("corpus"))
    known = counts.where(F.expr(f"kind = 1 AND term <> '' AND (n >= {LEAST_COUNT} OR length(term) <= {LEVELS[0]})"))
    terms = known.join(corpus, "term", "left").orderBy(F.desc("n"), F.length("term"), "term").limit(VOCABULARY).toPandas()
    strength = PRIOR_ROWS + PRIOR_SHARE * (n1 + n0)
    totals = (n1 + strength, n0 + strength)
    per_row = np.minimum(1, terms.corpus.fillna(0).to_numpy(float) / max(1, docs.count()))
    length = terms.term.str.len().to_numpy()
    done, scored = None, []
    for level in (*LEVELS, 0):
        low, high = (0, level) if level == LEVELS[0] else (level, level) if level else (LEVELS[-1] + 1, 1 << 30)
        own = terms[(length >= low) & (length <= high)]
        t1, t0 = own.toxic.to_numpy(float), own.clean.to_numpy(float)
        if done is None:
            prior = strength * per_row[(length >= low) & (length <= high)]
            beginning = np.zeros(len(own))
        else:
            parent = done.loc[own.term.str.slice(0, (LEVELS[LEVELS.index(level) - 1] if level else LEVELS[-1]))]
            prior = parent.prior.to_numpy() * np.minimum(1, own.n.to_numpy(float) / parent.n.to_numpy(float))
            beginning = parent.score.to_numpy()
        score = log_odds(t1, t0, prior, prior, totals)
        score = np.where(score == 0, beginning, score)
        scored.append((own.term, score))
        done = own.assign(prior=prior, score=score).set_index("term")
    return Model(pa.array([t for own, _ in scored for t in own], pa.large_string()), np.concatenate([x for _, x in scored]))


def find_segments(model: Model, texts: pa.Array) -> tuple[list[int], list[list[tuple[float, int, int]]]]:
    """Words and maximal segments of every text. Every occurrence of a word has its score."""
    offsets, codes, distinct = normal_words(texts)
    return np.diff(offsets).tolist(), maximal_segments(model.token_scores(distinct)[codes], offsets)


def scan(docs: DataFrame, model: Model, carried: str) -> DataFrame:
    """Of every row the integer column ``carried``, its words and all maximal segments: scores and word ranges."""
    schema = pa.schema([(carried, pa.int64()), ("n_words", pa.int64()), ("scores", pa.list_(pa.float64())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks_of(batches):
            lengths, segments = find_segments(shared.value, block["text"].combine_chunks())
            columns = [pa.array([[s[k] for s in row] for row in segments], schema.field(2 + k).type) for k in range(3)]
            yield from pa.Table.from_arrays([block["carried"].combine_chunks(), pa.array(lengths, pa.int64()), *columns], schema=schema).to_batches()

    rows = docs.select(F.col(carried).cast("long").alias("carried"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, f"{carried} long, n_words long, scores array<double>, first array<long>, last array<long>")


def calibrate(docs: DataFrame, sample: DataFrame, model: Model) -> Model:
    """Fit the extreme-value law to the clean calibrating rows and place the decision between the classes.

    The best scores of clean documents follow log(K n) / decay plus Gumbel noise; decay comes from their
    spread and is at most 1, that of true log-odds. The p-value of one half is where the calibrating rows are told
    apart best, in the middle of the gap; without toxic ones it stays 1e-3. The rows gathered are bounded by
    the sample.
    """
    chosen = F.broadcast(sample.where("calibrates").select("doc_id", "toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    seen = scan(rows, model, "toxic").select("n_words", "scores", "toxic").toPandas()
    clean = seen[(seen.toxic == 0) & (seen.n_words > 0)]
    if len(clean) >= 10:
        best = np.array([max(s, default=0.0) for s in clean.scores])
        log_n = np.log(clean.n_words.to_numpy(float))
        for _ in range(50):  # decay from the upper half: a few odd documents do not widen it
            middle, high = np.quantile(best - log_n / model.decay, [0.5, 0.9])
            decay = float(np.clip(GUMBEL_SPREAD / max(1e-9, high - middle), 0.05, 1.0))
            model.decay = 0.5 * (model.decay + decay)
        model.log_k = float(np.median(model.decay * best - log_n)) - GUMBEL_MEDIAN
    p = np.array([model.log_p(list(s), n) for s, n in zip(seen.scores, seen.n_words, strict=True)])
    toxic = seen.toxic.to_numpy() == 1
    if toxic.any() and (~toxic).any():
        order = np.argsort(p)
        # Wrong answers if the first k rows are called toxic.
        wrong = np.concatenate([[0], np.cumsum(~toxic[order])]) + toxic.sum() - np.concatenate([[0], np.cumsum(toxic[order])])
        edge = np.concatenate([[p.min() - 1], p[order], [p.max() + 1]])
        gaps = np.diff(edge)
        best_k = max((k for k in range(len(wrong)) if wrong[k] == wrong.min()), key=lambda k: gaps[k])
        model.log_alpha = float((edge[best_k] + edge[best_k + 1]) / 2)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents: scores from five sixths of the sample, calibration from the rest."""
    sample = stage(sampled_labels(labels, sample_rows))
    return calibrate(docs, sample, learn_scores(docs, sample))


def rate(model: Model, texts: pa.Array) -> tuple[list[float], list[int]]:
    """Score and number of significant passages of every text."""
    lengths, segments = find_segments(model, texts)
    scores = [model.score([s for s, _, _ in row], n) for row, n in zip(segments, lengths, strict=True)]
    return scores, [sum(s > model.level(n) for s, _, _ in row) for row, n in zip(segments, lengths, strict=True)]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages (significant ones) of every row.

    Null and empty texts have no passage and the score that follows from that. Repeated rows are scored
    repeatedly; other columns are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks_of(batches):
            scores, n = rate(shared.value, block["text"].combine_chunks())
            yield from pa.Table.from_arrays([block["doc_id"].combine_chunks(), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], schema=schema).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = rows.mapInArrow(run, "doc_id long, score double, n_passages long")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the column ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def compute(block: pa.Table) -> list[pa.Array]:
        return [pa.array(rate(shared.value, block.column(at).combine_chunks())[0], pa.float64())]

    return common.annotated(docs, {"score": pa.float64()}, compute)


def passages(docs: DataFrame, model: Model, most_e: float = 0.01) -> DataFrame:
    """Every passage whose expected number in a clean document of that length is at most ``most_e``."""
    found = scan(docs, model, "doc_id").select("doc_id", "n_words", F.explode(F.arrays_zip("scores", "first", "last")).alias("s"))
    e_value = F.exp(F.lit(model.log_k) + F.log("n_words") - F.lit(model.decay) * F.col("s.scores"))
    return found.select("doc_id", F.col("s.first").alias("first_word"), F.col("s.last").alias("last_word"), F.col("s.scores").alias("score"), e_value.alias("e_value")).where(F.col("e_value") <= most_e)
