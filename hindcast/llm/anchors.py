"""Removal of repeated passages by difference-cover anchors.

Two equal runs of ``window`` words lie at any offsets of their documents. Short windows are hashed only at
positions that fall on a difference cover modulo a period: whatever the two offsets, some cover
position lies within the first ``period`` words of both runs at once, so that a long match always shares an
anchor. Only around shared anchors are the long windows themselves hashed and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import stage

WINDOW = 50
# A perfect difference set; every residue but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Text of one shard, whose documents a task holds together.
SHARD_BYTES = 8 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def on_cover(positions: np.ndarray) -> np.ndarray:
    table = np.zeros(PERIOD, bool)
    table[list(COVER)] = True
    return table[positions % PERIOD]


class Block:
    """Words of some documents with what is hashed of them."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.offsets, self.words = common.split_words(texts)
        self.lengths = np.diff(self.offsets)
        self.rows = common.row_of(self.offsets)
        self.hashes = common.word_hashes(self.words, 1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Flat positions on the cover that begin a short window inside their document, and its hash."""
        short = self.window - PERIOD + 1
        hashes = common.window_hashes(self.hashes, short, BASES[0])
        n = len(hashes)
        if not n:
            return np.zeros(0, np.int64), hashes
        rows = self.rows[:n]
        places = np.flatnonzero(on_cover(np.arange(n) - self.offsets[rows]) & (np.arange(n) + short <= self.offsets[rows + 1]) & (self.lengths[rows] >= self.window))
        return places, hashes[places]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Flat positions of the long windows around shared anchors (flat positions)."""
        steps = np.zeros(len(self.rows) + 1, np.int64)
        rows = self.rows[shared]
        first = np.maximum(shared - PERIOD + 1, self.offsets[rows])
        last = np.minimum(shared, self.offsets[rows + 1] - self.window)
        fits = first <= last
        np.add.at(steps, first[fits], 1)
        np.add.at(steps, last[fits] + 1, -1)
        return np.flatnonzero(np.cumsum(steps[:-1]) > 0)

    def long_hashes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the long windows at ``places``."""
        second = common.word_hashes(self.words, 2)
        return common.window_hashes(self.hashes, self.window, BASES[1])[places], common.window_hashes(second, self.window, BASES[0])[places]

    def covered(self, places: np.ndarray) -> np.ndarray:
        """Which words the long windows at ``places`` cover."""
        steps = np.zeros(len(self.rows) + 1, np.int64)
        np.add.at(steps, places, 1)
        np.add.at(steps, places + self.window, -1)
        return np.cumsum(steps[:-1]) > 0


def kept_digest(text: str | None, removed: np.ndarray | None) -> str:
    """sha256 of the kept words, joined by one space."""
    words = (text or "").encode().split()
    if removed is not None:
        words = [words[i] for i in np.flatnonzero(~removed).tolist()]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of runs of consecutive positions."""
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    first = np.concatenate([places[:1], places[cuts]])
    return first, np.diff(np.concatenate([[0], cuts, [len(places)]]))


def _sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of a sorted partition, cut so that rows equal in the first ``keys`` columns stay together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        n = len(held[0])
        other = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:keys]], axis=0)) if n > 1 else []
        if len(other):
            cut = int(other[-1]) + 1
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _groups(columns: list[np.ndarray], keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row, and where groups start."""
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _table(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema).to_batches(max_chunksize=20_000)


def shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(shard, hash) of every anchor that occurs in two or more different texts.

    ``docs`` has doc_id, shard, mark (56 bits of the text's hash) and text. Copies of a text are settled without
    an answer, so of those in a block only the least doc_id speaks: copies hardly add to the rows of a hash.
    Rows of one hash come together sorted.
    """
    rows_schema = pa.schema([("hash", pa.int64()), ("mark", pa.int64()), ("shard", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.blocks_of(batches):
            block = Block(table["text"].combine_chunks(), window)
            places, hashes = block.anchors()
            rows = block.rows[places]
            columns = [hashes.view(np.int64), *(table[c].to_numpy()[rows] for c in ("mark", "doc_id", "shard"))]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            columns = [c[order] for c in columns]
            first = np.ones(len(order), bool)
            first[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            yield from _table([columns[k][first] for k in (0, 1, 3)], rows_schema)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _sorted_runs(batches, 1):
            group, starts = _groups(columns, 1)
            several = np.minimum.reduceat(columns[1], starts) != np.maximum.reduceat(columns[1], starts)
            keep = several[group]
            keep[1:] &= (columns[0][1:] != columns[0][:-1]) | (columns[2][1:] != columns[2][:-1])
            yield from _table([columns[2][keep], columns[0][keep]], pa.schema([("shard", pa.int64()), ("hash", pa.int64())]))

    rows = docs.select("text", "mark", "shard", "doc_id").mapInArrow(emit, "hash long, mark long, shard long")
    return rows.repartition("hash").sortWithinPartitions("hash", "shard").mapInArrow(share, "shard long, hash long")


CANDIDATES = "shard long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, first array<long>, n array<long>"


def candidate_documents(docs: DataFrame, shared: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """Every row with its words; those with windows around shared anchors also with text and the runs of windows.

    Rows of ``copies`` (shard, doc_id) repeat a whole smaller document and are settled here.
    """
    schema = pa.schema(
        [("shard", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("first", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]
    )

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right["kind"].to_numpy() if right.num_rows else np.zeros(0, np.int32)
        value = right["value"].to_numpy() if right.num_rows else np.zeros(0, np.int64)
        known, whole = np.sort(value[kind == 0].view(np.uint64)), set(value[kind == 1].tolist())
        out = []
        for table in common.blocks_of(iter(left.combine_chunks().to_batches())):
            texts, ids = table["text"].to_pylist(), table["doc_id"].to_pylist()
            block = Block(table["text"].combine_chunks(), window)
            places, hashes = block.anchors()
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            found = places[known[at] == hashes] if len(known) else places[:0]
            windows = block.candidates(found)
            cuts = np.searchsorted(windows, block.offsets)
            rows = []
            for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                own, n = windows[cuts[k] : cuts[k + 1]] - block.offsets[k], int(block.lengths[k])
                row = {"shard": table["shard"][k].as_py(), "doc_id": doc_id, "n_words": n, "n_removed": 0}
                if doc_id in whole:
                    row["n_removed"] = n if n >= window else 0
                    row["kept_sha256"] = kept_digest(None if n >= window else text, None)
                elif len(own) and doc_id is not None:
                    row["text"] = text
                    row["first"], row["n"] = _runs(own)
                else:
                    row["kept_sha256"] = kept_digest(text, None)
                rows.append(row)
            out.append(pa.Table.from_pylist(rows, schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    notes = shared.select("shard", F.lit(0).alias("kind"), F.col("hash").alias("value"))
    notes = notes.union(copies.select("shard", F.lit(1).alias("kind"), F.col("doc_id").alias("value")))
    left = docs.select("shard", "doc_id", "text").groupBy("shard")
    return left.cogroup(notes.groupBy("shard")).applyInArrow(settle, CANDIDATES)


def _places(table: pa.Table, block: Block) -> np.ndarray:
    """Flat positions of the runs of windows stored with each row."""
    first, n = table["first"].combine_chunks(), table["n"].combine_chunks()
    rows = np.repeat(np.arange(len(first)), np.diff(first.offsets.to_numpy()))
    starts, counts = first.flatten().to_numpy() + block.offsets[:-1][rows], n.flatten().to_numpy()
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def repeated_windows(candidates: DataFrame, window: int) -> DataFrame:
    """(shard, hash) of every candidate window that begins in a smaller document of another shard.

    Windows are compared by 64 and 32 bits of two independent hashes of all their words.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("shard", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.blocks_of(batches):
            block = Block(table["text"].combine_chunks(), window)
            places = _places(table, block)
            if not len(places):
                continue
            h1, h2 = block.long_hashes(places)
            rows = block.rows[places]
            doc, shard = table["doc_id"].to_numpy()[rows], table["shard"].to_numpy()[rows]
            h2 = (h2 >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((doc, h2, h1, shard))
            columns = [x[order] for x in (h1.view(np.int64), h2, doc, shard)]
            # Of a shard's windows of one content the smallest document speaks for all.
            keep = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in (columns[0], columns[1], columns[3])], axis=0)])
            yield from _table([c[keep] for c in columns], schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _sorted_runs(batches, 2):
            group, starts = _groups(columns, 2)
            least = columns[2][starts]  # sorted by document within a group
            own = columns[2] == least[group]
            # Shards that hold the smallest document themselves see the rest of theirs without an answer.
            home = set(zip(group[own].tolist(), columns[3][own].tolist(), strict=True))
            keep = ~own
            if len(home) and keep.any():
                at = np.flatnonzero(keep)
                keep[at] = [x not in home for x in zip(group[at].tolist(), columns[3][at].tolist(), strict=True)]
            yield from _table([columns[3][keep], columns[0][keep]], pa.schema([("shard", pa.int64()), ("hash", pa.int64())]))

    rows = candidates.where("text IS NOT NULL").select("shard", "doc_id", "text", "first", "n")
    flat = rows.mapInArrow(emit, "h1 long, h2 long, doc_id long, shard long")
    return flat.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(answer, "shard long, hash long")


def settled(candidates: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """The rows of candidate documents with the words removed."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        known = np.unique(right["hash"].to_numpy()) if right.num_rows else np.zeros(0, np.int64)
        parts = [(t, Block(t["text"].combine_chunks(), window)) for t in common.blocks_of(iter(left.combine_chunks().to_batches()))]
        places = [_places(t, b) for t, b in parts]
        hashes = [b.long_hashes(p) for (_, b), p in zip(parts, places, strict=True)]
        h1, h2 = (np.concatenate([h[k] for h in hashes]).view(np.int64) for k in (0, 1))
        doc = np.concatenate([t["doc_id"].to_numpy()[b.rows[p]] for (t, b), p in zip(parts, places, strict=True)])
        # Within the shard: windows whose content begins in a smaller document here.
        order = np.lexsort((doc, h2, h1))
        group, starts = _groups([h1[order], h2[order]], 2) if len(order) else (order, order)
        bad = np.zeros(len(order), bool)
        if len(order):
            bad[order] = doc[order] > doc[order][starts][group]
            if len(known):
                at = np.minimum(np.searchsorted(known, h1), len(known) - 1)
                bad |= known[at] == h1
        out, upto = [], 0
        for (t, b), p in zip(parts, places, strict=True):
            gone = b.covered(p[bad[upto : upto + len(p)]])
            upto += len(p)
            for k, (doc_id, text) in enumerate(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)):
                own = gone[b.offsets[k] : b.offsets[k + 1]]
                out.append({"doc_id": doc_id, "n_words": len(own), "n_removed": int(own.sum()), "kept_sha256": kept_digest(text, own)})
        return pa.Table.from_pylist(out, schema)

    left = candidates.where("text IS NOT NULL").select("shard", "doc_id", "text", "first", "n").groupBy("shard")
    return left.cogroup(repeated.groupBy("shard")).applyInArrow(settle, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word is removed if a run of ``window`` words around it also begins in a document with a smaller doc_id; all
    judged on the input. Null and empty texts have no words. A row with a null doc_id is neither removed
    from nor a source; rows that share a doc_id are no sources for each other. Documents of equal text are
    told by a hash of it: the smallest speaks for all, and the others are removed whole.
    """
    if window < PERIOD + 1:
        raise ValueError("the window must be longer than the period of the cover")
    text = F.col("text").cast("string")
    n_shards = common.shards(docs, "text", shard_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"mark": F.shiftright(F.xxhash64(text), 8), "shard": F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_shards))}
    )
    marks = stage(rows.where("doc_id IS NOT NULL").select("doc_id", "shard", "mark", F.xxhash64("text", F.lit(1)).alias("mark2")))
    groups = marks.groupBy("mark", "mark2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    groups = stage(groups.where("n > 1").drop("n"))
    copies = stage(marks.join(groups, ["mark", "mark2"]).where("doc_id > least").select("shard", "doc_id"))
    shared = stage(shared_anchors(rows.where("doc_id IS NOT NULL"), window))
    candidates = stage(candidate_documents(rows, shared, copies, window))
    repeated = stage(repeated_windows(candidates, window))
    done = candidates.where("text IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(settled(candidates, repeated, window))
