"""Spelling variants by PartEnum signatures, as DataFrame expressions.

A word's letters are a multiset: a binary vector over (letter, occurrence). One edit changes at most two of
its places. The letters are dealt into parts of equal weight, and all choices of parts that leave two
out are enumerated: whatever two places differ, one choice misses both, so that near words agree on its
signature. Signatures meet in an equi-join, joined by a half of the word that one edit leaves alone, and
the edit distance verifies what meets.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import stage

#: Runs of letters of at least ``LEAST_LETTERS``; shorter runs cannot become words.
LEAST_LETTERS = 7
RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
DROPPED = 31
#: Binary vectors of near words differ in at most so many places; parts the letters are dealt into.
DISTANCE, PARTS = 2, 4
#: A form occurs at least so many times as often as the word it is the form of.
FORM_RATIO = 10


def word_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """``word`` and its occurrences ``n`` over all documents, of at least seven letters and ``least`` times.

    Occurrences are counted in each task before they are shuffled. A null doc_id is hashed as an empty text.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"),
    ).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DROPPED == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def letter_parts(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of all words dealt into parts of nearly equal weight; one row a letter reaches the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    weights = [(r.n, r.letter) for r in letters.groupBy("letter").agg(F.count("*").alias("n")).collect()]
    dealt, loads = [""] * parts, [0] * parts
    for weight, letter in sorted(weights, key=lambda w: (-w[0], w[1])):
        lightest = loads.index(min(loads))
        dealt[lightest] += letter
        loads[lightest] += weight
    return dealt


def signatures(word: Column, parts: list[str], distance: int = DISTANCE) -> list[Column]:
    """One signature for each choice of parts that leaves ``distance`` of them out.

    A signature is a hash of the choice and the letters of the word in its parts, in order.
    """
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    chosen = itertools.combinations(range(len(parts)), len(parts) - distance)
    everything = "".join(parts)

    def kept(choice: tuple[int, ...]) -> Column:
        others = "".join(c for c in everything if c not in "".join(parts[p] for p in choice))
        return F.translate(letters, others, "") if others else letters

    return [F.xxhash64(F.lit(k), kept(choice)) for k, choice in enumerate(chosen)]


def halves(word: Column) -> Column:
    """Beginnings and ends of which two words one edit apart share one.

    The shorter word has m letters; an edit in one half of it leaves the m // 2 letters of the other alone.
    A word may be the shorter or the longer one, so both lengths are given.
    """
    n = F.length(word)
    lengths = F.array_distinct(F.array((n / 2).cast("int"), ((n - 1) / 2).cast("int")))
    first = F.transform(lengths, lambda k: F.xxhash64(F.lit("first"), F.substring(word, F.lit(1), k)))
    last = F.transform(lengths, lambda k: F.xxhash64(F.lit("last"), F.substring(word, n - k + 1, k)))
    return F.concat(first, last)


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of distinct words at an edit distance of one: a, n_a, b, n_b with a < b.

    A word that edits to itself is no pair. Words meet under few keys each; the distance is tested
    inside the join, and a pair that met under several keys stays once.
    """
    word = F.col("word")
    keyed = words.select("word", "n", F.array(*signatures(word, letter_parts(words))).alias("signatures"), halves(word).alias("halves"))
    keyed = keyed.select("word", "n", F.explode("signatures").alias("signature"), "halves")
    keyed = keyed.select("word", "n", F.explode("halves").alias("half"), "signature")
    keyed = stage(keyed.select(F.xxhash64("signature", "half").alias("key"), "word", "n"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and its ``root`` for rows of a word and its form, every form followed to the last.

    Each round halves what is left of every chain. A form is at least ``FORM_RATIO`` times as frequent as its
    word, so chains end after as many steps as a long has digits.
    """
    now = stage(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):  # 2**5 steps are more than a long can multiply by ten
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def spelling_forms(docs: DataFrame) -> DataFrame:
    """Words of all documents with their near words: word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (ties: the least in code-point order), if that is at least ten
    times as frequent; root is the end of the chain of forms. Null and empty texts have no words; repeated
    rows count repeatedly; a null doc_id hashes as an empty one; other columns are ignored. No rows, no words.
    """
    words = stage(word_counts(docs))
    pairs = stage(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = stage(
        words.join(found, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("best.less") >= FORM_RATIO * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"),
        )
    ).select("word", "n", "n_near", "to.form", "to.form_n")
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB's SQL: crc32 by its bitwise definition, and all words of nearly equal length compared. The
#: accented letters are mapped to single bytes first, since levenshtein counts bytes there.
SPELLING_FORMS_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{LEAST_LETTERS},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
occurring AS (SELECT doc, run, count(*) AS n, encode(doc || ':' || run) AS b FROM runs GROUP BY ALL),
polynomial AS (SELECT list(v ORDER BY k) AS t FROM (
  WITH RECURSIVE s AS (SELECT range AS k, range::BIGINT AS v, 0 AS i FROM range(256)
    UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM s WHERE i < 8)
  SELECT k, v FROM s WHERE i = 8)),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::INT]))) AS h FROM occurring, polynomial),
cut AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= 2),
plain AS (SELECT word, n, length(word) AS l, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[\\]^_`~') AS p FROM words),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM plain a JOIN plain b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND a.word <> b.word
  WHERE levenshtein(a.p, b.p) = 1),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS best FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {FORM_RATIO} * w.n THEN best.near END AS form,
  CASE WHEN -best.less >= {FORM_RATIO} * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.at AS root FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
