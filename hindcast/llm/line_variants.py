"""Line dedup within an edit bound by deletion neighbourhoods.

Two lines whose word sequences differ by one insertion, deletion or substitution share a variant: the
sequence without one word, or the shorter line itself. Variants are emitted as hashed keys for lines that share half of
their words, at either end, with another line; equal keys meet, the places of the deletions verify the distance,
and the earliest line stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import stage

#: Shorter lines are repeated only by equal ones.
LEAST_WORDS = 4
SHARD_BYTES = 8 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Ranges:
    """Hashes of any ranges of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * common.powers(base, len(hashes)), dtype=np.uint64)])
        self.inverse = common.powers(pow(base, -1, 1 << 64), len(hashes) + 2)

    def raw(self, start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[shift]

    def whole(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix(self.raw(start, end, start) + common.mix((end - start).astype(np.uint64)))

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the ranges less the word at ``at``: the same as if that word had never been there."""
        value = self.raw(start, at, start) + self.raw(at + 1, end, start + 1)
        return common.mix(value + common.mix((end - start - 1).astype(np.uint64)))


class Lines:
    """The lines of some texts as word sequences; lines without words are left out, as are those that ``among``,
    given text indexes and numbers of lines, is not true for."""

    def __init__(self, texts: pa.Array, among: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, "\n")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        lines = split.flatten()
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        number = np.arange(len(lines)) - bounds[:-1][text]
        if among is not None:
            chosen = np.flatnonzero(among(text, number))
            lines, text, number = lines.take(pa.array(chosen)), text[chosen], number[chosen]
        offsets, words = common.split_flat(lines)
        full = np.flatnonzero(np.diff(offsets))
        self.text, self.number = text[full], number[full]
        self.start, self.end = offsets[:-1][full], offsets[1:][full]
        self.n = self.end - self.start
        first = common.flat_hashes(words, 1)
        # Two bases make the hashes of sequences independent; the words' second hashes come from the first.
        self.ranges = [Ranges(h, base) for h, base in zip((first, common.mix(first ^ np.uint64(BASES[1]))), BASES, strict=True)]
        self.h1, self.h2 = (r.whole(self.start, self.end) for r in self.ranges)

    def half_keys(self, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Line indexes and hashes of the halves at both ends; lengths of which lines one word apart share one."""
        rows = np.flatnonzero(self.n >= least_words)
        lines, keys = [], []
        for less in (0, 1):
            half = (self.n[rows] - less) // 2
            for side, start, end in ((1, self.start[rows], self.start[rows] + half), (2, self.end[rows] - half, self.end[rows])):
                lines.append(rows)
                keys.append(common.mix(self.ranges[0].whole(start, end) + np.uint64(side)))
        return np.concatenate(lines), np.concatenate(keys)

    def variants(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the lines ``rows``: line index, position of the deletion (-1: none) and two hashes of what is left."""
        n = self.n[rows]
        line = np.repeat(rows, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hashes = [r.without(self.start[line], self.end[line], self.start[line] + at) for r in self.ranges]
        return (
            np.concatenate([rows, line]),
            np.concatenate([np.full(len(rows), -1), at]),
            *(np.concatenate([h[rows], v]) for h, v in zip((self.h1, self.h2), hashes, strict=True)),
        )


def _table(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema).to_batches(max_chunksize=20_000)


def _schema(names: str) -> tuple[pa.Schema, str]:
    return pa.schema([(x, pa.int64()) for x in names.split()]), ", ".join(f"{x} long" for x in names.split())


def line_table(docs: DataFrame) -> DataFrame:
    """Every line with words: h1, h2, doc_id, number (from 0 within its text), shard."""
    schema, ddl = _schema("h1 h2 doc_id number shard")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.blocks_of(batches):
            lines = Lines(table["text"].combine_chunks())
            ids, shard = table["doc_id"].to_numpy(), table["shard"].to_numpy()
            yield from _table([lines.h1.view(np.int64), lines.h2.view(np.int64), ids[lines.text], lines.number, shard[lines.text]], schema)

    return docs.mapInArrow(emit, ddl)


def shared_halves(docs: DataFrame, least_words: int) -> DataFrame:
    """(h1, h2) of lines that share a half with another line. A key's lines are told apart by their least and
    greatest hash, added up before the shuffle."""
    schema, ddl = _schema("key h1 h2")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.blocks_of(batches):
            lines = Lines(table["text"].combine_chunks())
            row, key = lines.half_keys(least_words)
            columns = [key.view(np.int64), lines.h1[row].view(np.int64), lines.h2[row].view(np.int64)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            first = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]) if len(order) else np.zeros(0, bool)
            yield from _table([c[first] for c in columns], schema)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by key and line: a line leaves when its key has shown a second one. Of each key one line is held.
        out_schema, _ = _schema("h1 h2")
        last: tuple | None = None
        told = False
        for block in common.blocks_of(batches):
            key, h1, h2 = (c.to_numpy() for c in block.columns)
            if last is not None:
                key, h1, h2 = (np.concatenate([[a], b]) for a, b in zip(last, (key, h1, h2), strict=True))
            same_key = np.concatenate([[False], key[1:] == key[:-1]])
            same_line = same_key & np.concatenate([[False], h1[1:] == h1[:-1]])
            start = np.flatnonzero(~same_key)
            group = np.cumsum(~same_key) - 1
            other = h1 != h1[start][group]
            several = np.logical_or.reduceat(other, start)
            if last is not None and told:
                several[0] = True
            keep = several[group] & ~same_line
            if last is not None and told:
                keep[0] = False  # it has left before
            yield from _table([h1[keep], h2[keep]], out_schema)
            told = bool(several[-1])
            last = (key[-1], h1[-1], h2[-1])

    flat = docs.select("text").mapInArrow(emit, ddl)
    return flat.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(share, "h1 long, h2 long").distinct()


def near_earlier(blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """(doc_id, number) of lines with an earlier line one edit away; some of them repeatedly.

    ``blocks`` have v1, v2, at, doc_id and number, sorted by variant, place of the deletion and order of lines. The line
    without a deletion (place -1) is one edit from all others of its variant; two with a deletion are where the places
    agree. A variant's first row and the first row of its last place go on to the next block.
    """
    schema, _ = _schema("doc_id number")
    held: list[np.ndarray] | None = None
    for block in blocks:
        columns = [c.to_numpy() for c in block.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        v1, v2, at, doc, number = columns
        new = np.concatenate([[True], (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1])])
        new_place = new | np.concatenate([[True], at[1:] != at[:-1]])
        starts, places = np.flatnonzero(new), np.flatnonzero(new_place)
        start, place = starts[np.cumsum(new) - 1], places[np.cumsum(new_place) - 1]
        less = at >= 0
        beside = less & (at[start] == -1)  # the variant is a line itself
        behind = (doc > doc[start]) | ((doc == doc[start]) & (number > number[start]))
        before = (doc < doc[start]) | ((doc == doc[start]) & (number < number[start]))
        later = (doc != doc[place]) | (number != number[place])
        gone = np.unique(np.concatenate([np.flatnonzero((less & later) | (beside & behind)), start[beside & before]]))
        yield from _table([doc[gone], number[gone]], schema)
        last = np.unique([starts[-1], places[-1]])
        held = [c[last] for c in columns]


def removed_near(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, number) of the ``wanted`` lines that are one edit from an earlier one.

    ``wanted`` has shard, h1, doc_id and number of each line's first place, where its variants are made.
    """
    schema, ddl = _schema("v1 v2 at doc_id number")

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        places = set(zip(right["doc_id"].to_pylist(), right["number"].to_pylist(), right["h1"].to_pylist(), strict=True))
        docs_, numbers = right["doc_id"].to_numpy(), right["number"].to_numpy()
        known, beyond = np.unique(docs_), numbers.max() + 1
        codes = np.unique(np.searchsorted(known, docs_) * beyond + numbers)
        out = []
        for table in common.blocks_of(iter(left.combine_chunks().to_batches())):
            ids = table["doc_id"].to_numpy()
            place = np.searchsorted(known, ids).clip(max=len(known) - 1)
            place[known[place] != ids] = -1

            def among(text: np.ndarray, number: np.ndarray, place: np.ndarray = place) -> np.ndarray:
                return (place[text] >= 0) & (number < beyond) & np.isin(place[text] * beyond + number, codes)

            lines = Lines(table["text"].combine_chunks(), among)
            h1 = lines.h1.view(np.int64)
            # Rows that share a doc_id may have other lines in the same place.
            found = zip(ids[lines.text].tolist(), lines.number.tolist(), h1.tolist(), strict=True)
            rows = np.array([i for i, line in enumerate(found) if line in places], np.int64)
            row, at, v1, v2 = lines.variants(rows)
            columns = [v1.view(np.int64), v2.view(np.int64), at, ids[lines.text[row]], lines.number[row]]
            out.append(pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return near_earlier(common.blocks_of(batches))

    flat = docs.select("shard", "doc_id", "text").groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(emit, ddl)
    return flat.repartition("v1").sortWithinPartitions("v1", "v2", "at", "doc_id", "number").mapInArrow(judge, "doc_id long, number long").distinct()


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_lines (with words), n_removed and removed_lines (numbers from 0, ascending) of every row.

    Lines are cut at line feeds and compared as word sequences, so that white space does not count. A line
    is removed if an earlier line, by doc_id and number, is equal or, from ``least_words`` words on for both, one word edit
    away; all judged on the input. Lines without words are neither counted nor removed. Null and empty
    texts have no lines. Rows with a null doc_id keep all lines and are no sources. Rows that share a doc_id
    are one document: lines of equal number do not remove one another, and where such lines differ, one goes with the other.
    """
    n_shards = common.shards(docs, "text", shard_bytes)
    ident = F.col("doc_id").cast("long")
    rows = docs.select(ident.alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(ident), F.lit(n_shards)).alias("shard"))
    known = rows.where("doc_id IS NOT NULL")
    lines = stage(line_table(known))
    classes = stage(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "number", "shard")).alias("first"), F.count("*").alias("n")))
    halves = stage(shared_halves(known, least_words))
    wanted = stage(classes.join(halves, ["h1", "h2"]).select("first.shard", "h1", "first.doc_id", "first.number"))
    near = stage(removed_near(known, wanted))
    placed = classes.select("h1", "h2", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.number").alias("first_number"))
    near = near.select(F.col("doc_id").alias("first_doc"), F.col("number").alias("first_number"), F.lit(True).alias("near"))
    flagged = placed.join(near, ["first_doc", "first_number"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    flagged = stage(flagged.where("n > 1 OR near").drop("n"))
    gone = lines.join(flagged, ["h1", "h2"]).where("near OR doc_id <> first_doc OR number <> first_number")
    removed = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("number")).alias("removed_lines"))
    counts = lines.groupBy("doc_id").agg(F.count_distinct("number").alias("n_lines"))
    out = rows.select("doc_id").join(counts, "doc_id", "left").join(removed, "doc_id", "left")
    numbers = F.coalesce("removed_lines", F.array().cast("array<long>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(numbers).cast("long").alias("n_removed"), numbers.alias("removed_lines"))


def repeated_lines_sql(least_words: int = LEAST_WORDS) -> str:
    """The same rows in DuckDB's SQL."""
    return f"""
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT doc_id, number, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM t WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS MATERIALIZED (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min((doc_id, number)) AS first FROM l GROUP BY 1),
v AS MATERIALIZED (SELECT s, first, len(w) AS n, unnest(range(1, len(w) + 1)) AS pos, array_to_string(list_concat(w[:pos - 1], w[pos + 1:]), ' ') AS key FROM c WHERE len(w) >= {least_words}),
near AS (SELECT a.s FROM v a JOIN (SELECT key, pos, n, min(first) AS least FROM v GROUP BY ALL) m ON m.key = a.key AND m.pos = a.pos AND m.n = a.n WHERE m.least < a.first
  UNION SELECT a.s FROM v a JOIN c ON c.s = a.key WHERE len(c.w) >= {least_words} AND c.first < a.first
  UNION SELECT c.s FROM v a JOIN c ON c.s = a.key WHERE len(c.w) >= {least_words} AND a.first < c.first),
gone AS (SELECT l.doc_id, l.number FROM l JOIN c ON c.s = array_to_string(l.w, ' ') LEFT JOIN near ON near.s = c.s WHERE near.s IS NOT NULL OR c.first <> (l.doc_id, l.number)),
r AS (SELECT doc_id, list(DISTINCT number ORDER BY number) AS removed_lines FROM gone GROUP BY 1),
k AS (SELECT doc_id, count(DISTINCT number) AS n_lines FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(len(removed_lines), 0) AS n_removed, coalesce(removed_lines, []) AS removed_lines
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)"""
