"""Near-duplicates by a chosen-path set similarity join.

Every document is the set of its word shingles, known by a sketch of minwise tokens. Independent trees
branch the documents: each node chooses a few sketch positions, and a document goes to the child of the
token it has there. Similar documents share a path with a chance that grows with their similarity. Small
nodes are compared exhaustively on sketches, large ones branch again; what sketches suggest is confirmed
on full sets. ``TREES`` trees with ``BRANCHES`` choices a node miss a pair at the threshold with
a chance of about (1/16)**TREES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import stage
from hindcast.llm.components import components

TREES, BRANCHES = 4, 2
#: Sketch positions; a document's sketch has one byte for each, and two bytes for each position the roots use.
SKETCH = 128
#: Pairs below the threshold by more than this many standard errors of the sketch are no candidates.
SKETCH_ERRORS = 4.0
#: Nodes up to this size are compared exhaustively as they are.
SMALL = 48
#: Nodes up to this size are finished inside a task; larger ones branch across the cluster.
TASK_ROWS = 8_000
#: Shingles whose documents a task compares on full sets at once.
TASK_ITEMS = 2_000_000
#: Distributed branchings of a node before it is cut into blocks.
MOST_LEVELS = 14
#: Documents that every block of a cut node has besides its own, in the first look.
PIVOTS = 64
#: Identifiers that may be broadcast; more are joined.
BROADCAST_IDS = 2_000_000


def coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the sorted distinct shingle hashes of every text.

    A-Z are lowered. A text with fewer words than a shingle is one shingle; one without words has none.
    """
    offsets, tokens = common.split_words(texts, lower=True)
    hashes = common.word_hashes(tokens, 11)
    windows = common.window_hashes(hashes, words)
    whole = common.whole_hashes(hashes, offsets)
    parts = []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= words:
            own = np.sort(windows[a : b - words + 1])
            parts.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            parts.append(whole[row : row + 1] if b > a else whole[:0])
    return np.cumsum([0, *map(len, parts)]), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def sketches(offsets: np.ndarray, values: np.ndarray, seed: int = 5) -> np.ndarray:
    """Minwise tokens of every non-empty set, one row each; rows of empty sets are zero.

    Tokens have 16 bits; comparisons use the lower 8 of them, by which unlike tokens agree once in 256 times.
    """
    out = np.zeros((len(offsets) - 1, SKETCH), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    short = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    starts = offsets[:-1][full]
    for k, (a, b) in enumerate(zip(*coefficients(seed), strict=True)):
        least = np.minimum.reduceat(short * a + b, starts)
        out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


BASE = "doc_id long, n_shingles long, s1 long, s2 long, sketch binary, rooted binary"


def described(docs: DataFrame, words: int) -> DataFrame:
    """Of every row the size of its set, 128 bits that stand for the set, and its sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("rooted", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks_of(batches):
            offsets, values = shingle_sets(block["text"].combine_chunks(), words)
            marks = [common.whole_hashes(common.mix(values ^ np.uint64(k)), offsets, b).view(np.int64) for k, b in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB))]
            tokens = sketches(offsets, values)
            rows = [[x.tobytes() for x in part] for part in (tokens.astype(np.uint8), tokens[:, : TREES * BRANCHES])]
            yield from pa.Table.from_arrays([block["doc_id"].combine_chunks(), pa.array(np.diff(offsets)), *map(pa.array, marks), *(pa.array(r, pa.binary()) for r in rows)], schema=schema).to_batches(max_chunksize=4000)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BASE)


def roots(reps: DataFrame) -> DataFrame:
    """Every document in the children it goes to from the root of each tree: the first positions of the sketch."""
    keys = [F.xxhash64(F.lit(k), F.expr(f"substring(rooted, {2 * k + 1}, 2)")) for k in range(TREES * BRANCHES)]
    return reps.withColumn("node", F.explode(F.array(*keys))).drop("rooted")


def children(rows: DataFrame, level: int) -> DataFrame:
    """Every document in the children of its node, at positions that node and level choose."""
    keys = []
    for j in range(BRANCHES):
        position = F.pmod(F.xxhash64("node", F.lit(level), F.lit(j)), F.lit(SKETCH))
        keys.append(F.xxhash64("node", F.lit(j), F.substring("sketch", (position + 1).cast("int"), F.lit(1))))
    return rows.withColumn("node", F.explode(F.array(*keys)))


class NodeJoin:
    """Candidate pairs among the documents of one node that fits a task."""

    def __init__(self, percent: int):
        share = percent / 100
        self.percent, self.share = percent, share
        self.least = int(np.ceil(SKETCH * share - SKETCH_ERRORS * np.sqrt(SKETCH * share * (1 - share))))

    def take(self, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> None:
        self.ids, self.sizes, self.tokens = ids, sizes, tokens

    def leaves(self, node: int) -> Iterator[np.ndarray]:
        """Small nodes below this one, and groups that no branching makes smaller."""
        stack = [(np.arange(len(self.ids)), node & 0x7FFFFFFF, 0)]
        while stack:
            rows, path, level = stack.pop()
            if len(rows) <= SMALL:
                yield rows
                continue
            rng = np.random.default_rng([path, level])
            parts = []
            for position in rng.choice(SKETCH, BRANCHES, replace=False):
                own = self.tokens[rows, position]
                order = np.argsort(own, kind="stable")
                cuts = np.flatnonzero(np.diff(own[order])) + 1
                parts += [part for part in np.split(rows[order], cuts) if len(part) > 1]
            if sum(len(part) ** 2 for part in parts) > 0.9 * len(rows) ** 2:
                yield rows  # copies of one another: branching would compare more pairs, not fewer
                continue
            stack += [(part, int(rng.integers(1 << 31)), level + 1) for part in parts]

    def stripes(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Exhaustively, some rows at a time: where they begin, matches with all rows, and which are candidates."""
        n = len(rows)
        tokens, sizes = self.tokens[rows], self.sizes[rows]
        step = max(1, (1 << 22) // (n * SKETCH))
        for a in range(0, n, step):
            matches = (tokens[a : a + step, None, :] == tokens[None, :, :]).sum(2)
            small, large = np.minimum(sizes[a : a + step, None], sizes), np.maximum(sizes[a : a + step, None], sizes)
            ok = (matches >= self.least) & (small >= self.share * large - 1e-9)
            ok[np.arange(len(ok)), np.arange(a, a + len(ok))] = False
            yield a, matches, ok

    def pairs(self, node: int) -> tuple[dict, set]:
        """Chosen pairs with their matches, and the documents that have other candidate pairs left."""
        self.found: dict[tuple[int, int], int] = {}
        self.left: set[int] = set()
        for rows in self.leaves(node):
            self.compare(rows)
        return self.found, self.left

    def compare(self, rows: np.ndarray) -> None:
        """Of every document the best partner, and its match with the node's middle."""
        n = len(rows)
        tokens, sizes = self.tokens[rows], self.sizes[rows]
        totals = np.zeros(n)
        best = np.zeros((n, 2), np.int64)
        counts = np.zeros(n, np.int64)
        for a, matches, ok in self.stripes(rows):
            b = a + len(ok)
            matches = np.where(ok, matches, 0)
            totals[a:b] = matches.sum(1)
            counts[a:b] = ok.sum(1)
            best[a:b, 0], best[a:b, 1] = matches.argmax(1), matches.max(1)
        if not counts.any():
            return
        middle = int(np.argmax(totals))
        to_middle = (tokens == tokens[middle]).sum(1)
        size = np.minimum(sizes, sizes[middle]) >= self.share * np.maximum(sizes, sizes[middle]) - 1e-9
        for i in np.flatnonzero(counts).tolist():
            chosen = 0
            if i != middle and size[i] and to_middle[i] >= self.least:
                self.add(rows[i], rows[middle], int(to_middle[i]))
                chosen += 1
            if best[i, 1] and not (chosen and best[i, 0] == middle):
                self.add(rows[i], rows[best[i, 0]], int(best[i, 1]))
                chosen += 1
            if counts[i] > chosen:
                self.left.add(int(rows[i]))

    def add(self, i: int, j: int, matches: int) -> None:
        a, b = sorted((int(self.ids[i]), int(self.ids[j])))
        if a != b:
            self.found[a, b] = matches

    def doubtful(self, node: int, labels: np.ndarray, asks: np.ndarray) -> np.ndarray:
        """Which documents have a candidate of another component, one of the two asking."""
        out = np.zeros(len(self.ids), bool)
        for rows in self.leaves(node):
            label, ask = labels[rows], asks[rows]
            for a, _, ok in self.stripes(rows):
                b = a + len(ok)
                ok &= (label[a:b, None] != label) & (ask[a:b, None] | ask)
                out[rows[a:b]] |= ok.any(1)
        return out

    def spanning(self, labels: np.ndarray, asks: np.ndarray, offsets: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links on full sets between unlike components, each of which makes two components one.

        An asking document's set is held against all its candidates of other components at once. There are fewer
        links than components here, whatever the number of pairs that were compared.
        """
        label = labels.copy()
        values, codes = np.unique(items, return_inverse=True)
        marks = np.zeros(len(values), bool)
        n_items = np.diff(offsets)
        for i in np.flatnonzero(asks).tolist():
            matches = np.count_nonzero(self.tokens == self.tokens[i], axis=1)
            size = np.minimum(self.sizes, self.sizes[i]) >= self.share * np.maximum(self.sizes, self.sizes[i]) - 1e-9
            others = np.flatnonzero((matches >= self.least) & size & (label != label[i]))
            if not len(others):
                continue
            own = codes[offsets[i] : offsets[i + 1]]
            marks[own] = True
            hits = marks[np.concatenate([codes[offsets[j] : offsets[j + 1]] for j in others.tolist()])]
            marks[own] = False
            before = np.concatenate([[0], np.cumsum(hits)])
            ends = np.cumsum(n_items[others])
            shared = before[ends] - before[ends - n_items[others]]
            linked = 100 * shared >= self.percent * (n_items[i] + n_items[others] - shared)
            for j in others[linked].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield int(self.ids[i]), int(self.ids[j])


def node_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one node after another, from batches sorted by node."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        nodes = batch["node"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            if held and nodes[lo] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = nodes[lo]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    common.release()


def taken(join: NodeJoin, table: pa.Table) -> None:
    tokens = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
    join.take(table["rep_id"].to_numpy(), table["n_shingles"].to_numpy(), tokens)


JOINED = "node long, a long, b long, matches int"


def node_join(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of all nodes; a row with null b says that node has more pairs for document a.

    Rows of a node come together in one task, sorted, and are taken node by node.
    """
    schema = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("matches", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = NodeJoin(percent)

        def finish(nodes, ids, sizes, tokens, cuts):
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                join.take(ids[lo:hi], sizes[lo:hi], tokens[lo:hi])
                found, left = join.pairs(int(nodes[lo]))
                out += [(int(nodes[lo]), a, b, m) for (a, b), m in found.items()]
                out += [(int(nodes[lo]), int(ids[lo + i]), None, 0) for i in left]
            return out

        held = None
        for batch in batches:
            columns = [batch["node"].to_numpy(), batch["rep_id"].to_numpy(), batch["n_shingles"].to_numpy()]
            columns.append(np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH))
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(held[0])) + 1]).tolist()
            out = finish(*held, cuts)
            held = [x[cuts[-1] :] for x in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if held is not None and len(held[0]):
            out = finish(*held, [0, len(held[0])])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.select("node", "rep_id", "n_shingles", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(run, JOINED)


def faced(rows: DataFrame, load: Column, most: int) -> DataFrame:
    """Tasks in which the documents of a node meet those of other components, as new nodes with ``asks``.

    Of two documents in unlike components, one at least is outside the node's largest. Those outside ask:
    each part of them meets each block of all documents, and parts and blocks hold a load of about ``most``. Nodes of
    one component are left out. ``rows`` is a written table with ``label``.
    """
    by_label = rows.groupBy("node", "label").agg(F.sum(load).alias("load"))
    per_node = by_label.groupBy("node").agg(F.max(F.struct("load", "label")).alias("top"), F.sum("load").alias("load"), F.count("*").alias("labels"))
    many = lambda x: F.greatest(F.lit(1), F.ceil(x / most)).cast("int")
    nodes = stage(per_node.where("labels > 1").select("node", F.col("top.label").alias("main"), many(F.col("load") - F.col("top.load")).alias("parts"), many(F.col("load")).alias("blocks")))
    at = rows.join(nodes, "node").withColumns({"lone": F.col("label") != F.col("main"), "part": F.pmod(F.xxhash64("rep_id", "node", F.lit(31)), F.col("parts")).cast("int"), "block": F.pmod(F.xxhash64("rep_id", "node", F.lit(32)), F.col("blocks")).cast("int")})
    place = lambda p, b: F.struct(p.alias("p"), b.alias("b"))
    asked = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(p, F.col("block")))
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: place(F.col("part"), b))
    at = at.withColumn("place", F.explode(F.when(F.col("lone"), F.array_union(asked, asking)).otherwise(asked)))
    return at.select(F.xxhash64("node", "place.p", "place.b").alias("node"), "rep_id", "n_shingles", "sketch", "label", (F.col("lone") & (F.col("place.p") == F.col("part"))).alias("asks"))


def doubts(rows: DataFrame, percent: int) -> DataFrame:
    """The documents of each task of ``faced`` that have a candidate of another component there."""
    columns = ["node", "rep_id", "n_shingles", "sketch", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = NodeJoin(percent)
        for table in node_tables(batches):
            taken(join, table)
            asks = table["asks"].to_numpy(zero_copy_only=False)
            found = join.doubtful(table["node"][0].as_py(), table["label"].to_numpy(), asks)
            if found.any():
                yield from table.filter(pa.array(found)).select(columns).to_batches(max_chunksize=4000)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, rep_id long, n_shingles long, sketch binary, label long")


def spanning_links(rows: DataFrame, docs: DataFrame, words: int, percent: int, task_rows: int, task_items: int = TASK_ITEMS) -> DataFrame:
    """Confirmed links (a, b) that join the components of ``label`` within nodes of any size.

    Sketches find the documents in doubt, without a list of pairs; their full sets come to the node and are held
    against one another there. What leaves a task are links that join components, fewer than its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = NodeJoin(percent)
        for table in node_tables(batches):
            taken(join, table)
            lists = table["items"].combine_chunks()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = list(join.spanning(table["label"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False), offsets, lists.flatten().to_numpy()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    found = stage(doubts(faced(rows, F.lit(1), task_rows), percent))
    tasks = faced(found, F.col("n_shingles"), task_items)
    sets = full_sets(found.select(F.col("rep_id").alias("doc_id")).distinct(), docs, words)
    met = tasks.join(sets.withColumnRenamed("doc_id", "rep_id"), "rep_id").repartition("node").sortWithinPartitions("node")
    links = met.select("node", "rep_id", "n_shingles", "sketch", "label", "asks", "items").mapInArrow(run, "a long, b long")
    return stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def spread(reps: DataFrame, task_rows: int = TASK_ROWS, most_levels: int = MOST_LEVELS) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows of the nodes that fit a task, level by level, and rows of nodes that no branching makes small.

    The counts of nodes are added up before the shuffle; only the list of large ones is written.
    """
    done, rows = [], roots(reps)
    for level in range(most_levels):
        counts = rows.groupBy("node").agg(F.count("*").alias("n"))
        large = stage(counts.where(F.col("n") > task_rows).select("node"))
        if large.isEmpty():
            return [*done, rows], None
        done.append(rows.join(large, "node", "left_anti"))
        rows = stage(children(rows.join(large, "node", "left_semi"), level))
    counts = rows.groupBy("node").agg(F.count("*").alias("n"))
    large = stage(counts.where(F.col("n") > task_rows))
    if large.isEmpty():
        return [*done, rows], None
    return [*done, rows.join(large, "node", "left_anti")], stage(rows.join(large, "node"))


def blocks(stuck: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Nodes that stay large, cut into blocks; pivots are in every block."""
    n_blocks = F.ceil(F.col("n") * 2 / task_rows).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep_id", "node", F.lit(21)), n_blocks).cast("int"))
    rows = stuck.withColumn("block", F.explode(F.when(is_pivot(), F.sequence(F.lit(0), n_blocks - 1)).otherwise(own)))
    return rows.withColumn("node", F.xxhash64("node", "block")).drop("block", "n")


def is_pivot():
    """About ``PIVOTS`` documents of a large node, the same in every block."""
    return F.pmod(F.xxhash64("rep_id", F.lit(22)), F.col("n")) < PIVOTS


def full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the sorted shingle hashes of the documents with these identifiers."""
    schema = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks_of(batches):
            offsets, values = shingle_sets(block["text"].combine_chunks(), words)
            items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
            yield from pa.Table.from_arrays([block["doc_id"].combine_chunks(), items], schema=schema).to_batches(max_chunksize=500)

    ids = stage(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    return stage(rows.mapInArrow(run, "doc_id long, items array<long>"))


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, words)
    one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
    two = one.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("shared")
    return stage(two.withColumn("shared", shared).where(F.lit(100) * F.col("shared") >= F.lit(percent) * union).select("a", "b").distinct())


def labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the component of their document as ``label``; ``known`` comes from components()."""
    return rows.join(known.withColumnsRenamed({"node": "rep_id", "component": "label_"}), "rep_id", "left").withColumn("label", F.coalesce("label_", "rep_id")).drop("label_")


def similar_pairs(reps: DataFrame, docs: DataFrame, words: int, percent: int, task_rows: int = TASK_ROWS, most_levels: int = MOST_LEVELS) -> DataFrame:
    """Confirmed links (a, b) between different sets, enough of them to connect all that similarity connects.

    First the best pair of every document and its pair with a node's middle are confirmed, then the other pairs that
    nodes chose. Nodes with more candidates are looked at once more, between components only. Nodes that stay large
    are cut into blocks that share pivots at first; the last look takes them whole, so no two blocks stay apart.
    """
    done, stuck = spread(reps, task_rows, most_levels)
    if stuck is not None:
        done.append(blocks(stuck, task_rows))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more.select(rows.columns))
    joined = stage(node_join(rows, percent))
    pairs = joined.where("b IS NOT NULL")
    both = pairs.select("a", "b", "matches").union(pairs.select("b", "a", "matches")).toDF("a", "b", "matches")
    # The middle is the partner of many: of each document the best pair and the pair with the busiest partner.
    busy = stage(both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("busy")))
    best = both.join(busy, "b").groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best"), F.max(F.struct("busy", "matches", "b")).alias("hub"))
    first = best.select("a", F.explode(F.array("best.b", "hub.b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = stage(first)
    links = confirm(first, docs, words, percent)
    # What else the nodes chose between components, and then nodes with more candidates and those cut into blocks.
    other = pairs.select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    known = components(links)
    label = lambda df, c: df.join(known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_")), c, "left").withColumn(f"{c}_", F.coalesce(f"{c}_", c))
    other = stage(label(label(other, "a"), "b").where("a_ <> b_").select("a", "b"))
    if not other.isEmpty():
        links = links.union(confirm(other, docs, words, percent))
        known = components(links)
    again = rows.join(joined.where("b IS NULL").select("node").distinct(), "node", "left_semi")
    if stuck is not None:
        again = again.unionByName(stuck.select(again.columns))
    again = stage(labelled(again.select("node", "rep_id", "n_shingles", "sketch"), known))
    return links.union(spanning_links(again, docs, words, percent, task_rows))


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, task_rows: int = TASK_ROWS, most_levels: int = MOST_LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents link where 100 * |intersection| >= percent * |union| of their shingle sets. Equal sets are one
    document in the search; they all get its component. Rows without words, and with a null doc_id, link
    with nothing. A doc_id that comes twice with different texts is linked through either. component_id is the
    least doc_id reachable, and kept where it is the row's own.
    """
    base = stage(described(docs, words))
    classes = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n_shingles")
    reps = stage(classes.agg(F.min("doc_id").alias("rep_id"), F.first("sketch").alias("sketch"), F.first("rooted").alias("rooted")))
    links = similar_pairs(reps.select("rep_id", "n_shingles", "sketch", "rooted"), docs, words, percent, task_rows, most_levels)
    known = components(links).withColumnsRenamed({"node": "rep_id", "component": "reached"})
    final = stage(reps.select("s1", "s2", "n_shingles", "rep_id").join(known, "rep_id", "left").select("s1", "s2", "n_shingles", F.coalesce("reached", "rep_id").alias("component")))
    rows = base.select("doc_id", "n_shingles", "s1", "s2").join(final, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates_sql(words: int = 2, percent: int = 80) -> str:
    """The same rows in DuckDB's SQL: sets compared through shared rare shingles, then closed transitively."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS s FROM w),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
flat AS (SELECT id, n, unnest(s) AS x FROM classes),
freq AS (SELECT x, count(*) AS f FROM flat GROUP BY x),
ranked AS MATERIALIZED (SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY f, x) AS r FROM flat JOIN freq USING (x)),
prefix AS MATERIALIZED (SELECT * FROM ranked WHERE r <= n - ceil(n * {percent} / 100.0) + 1),
candidates AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT c.a, c.b FROM candidates c JOIN classes p ON p.id = c.a JOIN classes q ON q.id = c.b,
  (SELECT 1) WHERE 100 * len(list_intersect(p.s, q.s)) >= {percent} * (p.n + q.n - len(list_intersect(p.s, q.s)))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS node, id AS seen FROM classes UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen),
component AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN classes c ON c.s = list_sort(s.s) LEFT JOIN component k ON k.node = c.id"""
