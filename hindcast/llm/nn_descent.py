"""Near-duplicate vectors by NN-descent.

Random-hyperplane trees give every vector a first list of neighbours. Rounds of local joins then introduce
the neighbours of each vector to one another, until lists hardly change. A list that is full of links is
saturated: it is enlarged, through its neighbours' links, until nothing new is found. A sample of queries is
compared with all vectors to audit the recall, and more trees are grown while it is too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import stage
from hindcast.llm.components import components

#: Trees at first; list length; vectors of a leaf that are compared at once.
TREES, NEIGHBOURS, LEAF = 8, 8, 256
#: Rounds of local joins at most, and the share of changed list entries at which they end.
ROUNDS, SETTLED = 6, 0.01
#: Neighbours through whom a saturated list grows in a round.
GUIDES = 4
#: Queries of the audit, the recall it asks for, and how often trees are added before it fails loudly.
AUDIT, RECALL, GROWTHS = 256, 0.97, 4

EDGES = "u long, v long, sim double"
EDGE_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def vectors(rows: DataFrame) -> DataFrame:
    """Vectors that can link: vec_id, label, vec (doubles, divided by their length) and its dimension."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    known = known.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(finite)
    # Divided by the largest component first, so that no square leaves the range of doubles.
    most = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    known = known.withColumn("most", most).where("most > 0").withColumn("x", F.transform("x", lambda v: v / F.col("most")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return known.withColumn("norm", norm).select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda v: v / F.col("norm")).alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def edges_of(ids: np.ndarray, sims: np.ndarray, most: int) -> list[np.ndarray]:
    """The best ``most`` entries of each row of a square of similarities, itself left out."""
    np.fill_diagonal(sims, -2)
    most = min(most, len(ids) - 1)
    best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    rows = np.repeat(np.arange(len(ids)), most)
    return [ids[rows], ids[best.ravel()], sims[rows, best.ravel()]]


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition sorted by ``key``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held[key].to_numpy()
        cut = len(keys) - int((keys[::-1] != keys[-1]).argmax()) if (keys != keys[-1]).any() else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _write(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield from pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=EDGE_SCHEMA).to_batches(max_chunksize=20_000)


def tree_edges(items: DataFrame, sizes: DataFrame, trees: range, neighbours: int, leaf: int) -> DataFrame:
    """Edges among vectors that fall into one leaf of a tree.

    A leaf is a label and the signs of as many random projections as bring its mean size near a quarter of ``leaf``. Rows of a
    leaf are sorted along one more projection, and every run of at most ``leaf`` of them is compared; runs overlap by half.
    ``sizes`` has the number of vectors of each label and dimension.
    """
    schema = pa.schema([("node", pa.int64()), ("along", pa.float64()), ("vec_id", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, labels = batch["dim"].to_numpy(), batch["label"].to_numpy()
            bits = np.maximum(0, np.ceil(np.log2(np.maximum(1, batch["n"].to_numpy() / (leaf / 4))))).astype(int)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = batch["vec"].take(pa.array(rows))
                x = matrix(own)
                for tree in trees:
                    planes = np.random.default_rng([77, tree, int(dim)]).standard_normal((int(dim), 65))
                    signs = (x @ planes[:, :64] > 0).astype(np.uint64)
                    used = np.arange(64) < bits[rows][:, None]
                    codes = ((signs * used) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
                    keys = codes + common.mix(labels[rows].astype(np.uint64) * np.uint64(1_000_003) + np.uint64(tree * 4099 + int(dim)))
                    node = common.mix(keys).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(x @ planes[:, 64]), batch["vec_id"].take(pa.array(rows)), own], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The partition is sorted by leaf: windows of rows slide over it, and a leaf's rows wait only for half a window.
        held: pa.Table | None = None

        def windows(table: pa.Table, last: bool) -> tuple[list[list[np.ndarray]], pa.Table]:
            nodes = table["node"].to_numpy()
            ids = table["vec_id"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(nodes)) + 1, [len(nodes)]])
            out, keep_from = [], len(nodes)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                open_end = hi == len(nodes) and not last
                at = lo
                while hi - at > 1:
                    if open_end and hi - at <= leaf:
                        break
                    end = min(hi, at + leaf)
                    x = matrix(table["vec"].slice(at, end - at))
                    out.append(edges_of(ids[at:end], x @ x.T, neighbours))
                    if end == hi:
                        break
                    at += leaf // 2
                if open_end:
                    keep_from = at
            return out, table.slice(keep_from)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            out, held = windows(held.combine_chunks(), False)
            yield from _write(out)
        if held is not None and held.num_rows:
            out, _ = windows(held.combine_chunks(), True)
            yield from _write(out)

    rows = items.join(F.broadcast(sizes), ["label", "dim"]).select("vec_id", "label", "dim", "vec", "n")
    planted = rows.mapInArrow(plant, "node long, along double, vec_id long, vec array<double>")
    return planted.repartition("node").sortWithinPartitions("node", "along").mapInArrow(compare, EDGES)


def best_lists(edges: DataFrame, neighbours: int) -> DataFrame:
    """The best ``neighbours`` entries of each vector; the length of what a vector brings is bounded by trees and joins."""
    unique = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return unique.withColumn("rank", rank).where(F.col("rank") <= neighbours).drop("rank")


def local_join(graph: DataFrame, items: DataFrame, neighbours: int) -> DataFrame:
    """Similarities among the neighbours of every vector, of which at least one is fresh; the better ones.

    A vector's neighbours are those on its list and as many of those that list it. An entry leaves the task only if it
    beats the last one on the list of its vector.
    """
    reverse = graph.select(F.col("v").alias("w"), F.col("u").alias("m"), "fresh", "sim")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("sim"), "m"))
    reverse = reverse.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("w", "m", "fresh")
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("m"), "fresh").union(reverse).groupBy("w", "m").agg(F.max("fresh").alias("fresh"))
    last = graph.groupBy("u").agg(F.when(F.count("*") >= neighbours, F.min("sim")).otherwise(-2.0).alias("last"))
    known = items.join(last.withColumnRenamed("u", "vec_id"), "vec_id", "left").select(F.col("vec_id").alias("m"), "vec", F.coalesce("last", F.lit(-2.0)).alias("last"))
    rows = around.join(known, "m").select("w", "m", "fresh", "last", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "w"):
            centers, ids = table["w"].to_numpy(), table["m"].to_numpy()
            fresh, least = table["fresh"].to_numpy().astype(bool), table["last"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(centers)) + 1, [len(centers)]]).tolist()
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2 or not fresh[lo:hi].any():
                    continue
                x = matrix(table["vec"].slice(lo, hi - lo))
                sims = x @ x.T
                ok = (fresh[lo:hi, None] | fresh[lo:hi]) & (sims > least[lo:hi, None])
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                out.append([ids[lo:hi][i], ids[lo:hi][j], sims[i, j]])
            yield from _write(out)

    return rows.repartition("w").sortWithinPartitions("w").mapInArrow(run, EDGES)


def similarities(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(u, v, sim) of the pairs (u, v)."""
    a, b = items.select(F.col("vec_id").alias("u"), F.col("vec").alias("x")), items.select(F.col("vec_id").alias("v"), F.col("vec").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch["x"]).to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                sims = np.einsum("ij,ij->i", matrix(own["x"]), matrix(own["y"]))
                yield pa.RecordBatch.from_arrays([own["u"], own["v"], pa.array(sims)], schema=EDGE_SCHEMA)

    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(run, EDGES)


def enlarged(links: DataFrame, items: DataFrame, neighbours: int, threshold: float) -> DataFrame:
    """``links`` (u < v) with what saturated lists still lack.

    A vector with ``neighbours`` links or more has a full list. It asks a few of its links for all of
    theirs; what is new and similar enough is added, until nothing is.
    """
    while True:
        both = stage(links.union(links.select("v", "u")).toDF("u", "v"))
        full = both.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= neighbours).select("u")
        if full.isEmpty():
            return links
        rank = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))
        guides = both.join(full, "u", "left_semi").withColumn("rank", rank).where(F.col("rank") <= GUIDES).select("u", F.col("v").alias("guide"))
        seen = guides.join(both.toDF("guide", "v"), "guide").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = similarities(seen.join(links, ["u", "v"], "left_anti"), items).where(F.col("sim") >= threshold).select("u", "v")
        new = stage(new)
        if new.isEmpty():
            return links
        links = stage(links.union(new))


def audit(links: DataFrame, items: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Recall of the worst size class: queries are put together by how many true links they have, in powers of two.

    Half of the queries are drawn from vectors that have links, half from all; their number bounds what is
    gathered. They are compared with all vectors, in blocks. Every query counts alike within its class, so that
    a large group hides no small one.
    """
    order = F.xxhash64("vec_id", F.lit(5))
    linked = links.select(F.explode(F.array("u", "v")).alias("vec_id")).distinct().orderBy(order).limit(queries // 2)
    chosen = items.join(F.broadcast(linked), "vec_id", "left_semi").union(items.orderBy(order).limit(queries // 2)).dropDuplicates(["vec_id"]).collect()
    by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r.label, r.dim) for r in chosen}:
        own = [r for r in chosen if (r.label, r.dim) == key]
        by[key] = np.array([r.vec_id for r in own]), np.array([r.vec for r in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch["label"].to_numpy(), batch["dim"].to_numpy()
            for (label, dim), (ids, x) in by.items():
                rows = np.flatnonzero((labels == label) & (dims == dim))
                if len(rows):
                    i, j = np.nonzero(matrix(batch["vec"].take(pa.array(rows))) @ x.T >= threshold)
                    other = batch["vec_id"].to_numpy()[rows[i]]
                    keep = other != ids[j]
                    yield from _write([[ids[j][keep], other[keep], np.ones(keep.sum())]])

    true = items.select("vec_id", "label", "dim", "vec").mapInArrow(run, EDGES).select("u", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    found = links.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).alias("hit"))
    counted = true.join(found, ["a", "b"], "left").groupBy("u").agg(F.count("*").alias("n"), F.count("hit").alias("found")).collect()
    shares: dict[int, list[float]] = {}
    for r in counted:
        shares.setdefault(r.n.bit_length(), []).append(r.found / r.n)
    return min((float(np.mean(s)) for s in shares.values()), default=1.0)


def similar_vectors(items: DataFrame, threshold: float, neighbours: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> tuple[DataFrame, float]:
    """Links (u < v) found among ``items`` and the recall that the audit measured."""
    sizes = stage(items.groupBy("label", "dim").agg(F.count("*").alias("n")))
    links, first, measured, graph = None, 0, 0.0, None
    for _ in range(GROWTHS):
        edges = tree_edges(items, sizes, range(first, first + trees), neighbours, leaf).withColumn("fresh", F.lit(1))
        edges = stage(edges)
        found = [edges]
        graph = stage(best_lists(edges if graph is None else edges.unionByName(graph.withColumn("fresh", F.lit(0))), neighbours))
        for _ in range(ROUNDS):
            joined = stage(local_join(graph, items, neighbours))
            found.append(joined)
            graph = stage(best_lists(graph.withColumn("fresh", F.lit(0)).unionByName(joined.withColumn("fresh", F.lit(1))), neighbours))
            state = graph.agg(F.sum("fresh"), F.count("*")).first()
            if (state[0] or 0) <= SETTLED * (state[1] or 0):
                break
        near = links
        for part in found:
            own = part.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            near = own if near is None else near.union(own)
        links = enlarged(stage(near.distinct()), items, neighbours, threshold)
        measured = audit(links, items, threshold)
        if measured >= recall:
            return links, measured
        first, trees = first + trees, trees * 2
    raise RuntimeError(f"recall {measured:.3f} after {first} trees; more neighbours are needed")


def vector_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors, and the class of every vector that can link.

    Classes: vec_id (the least of the class), label, dim, vec, weight (its vectors). Members: vec_id, class. Of
    rows that share a vec_id, the one with the least label and vector counts. Two hashes of 64 bits decide
    that vectors are equal; copies are counted in each task before they are exchanged.
    """
    one = vectors(rows).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vec")).alias("m")).select("vec_id", "m.*")
    items = stage(one.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    key = ["label", "dim", "h1", "h2"]
    classes = items.groupBy(*key).agg(F.min(F.struct("vec_id", "vec")).alias("m"), F.count("*").alias("weight"))
    classes = stage(classes.select(*key, "m.*", "weight"))
    members = items.select("vec_id", *key).join(classes.select(*key, F.col("vec_id").alias("class")), key).select("vec_id", "class")
    return classes.drop("h1", "h2"), members


def near_vectors(rows: DataFrame, threshold: float = 0.98, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall of every row.

    Vectors are compared within equal, non-null labels and equal dimensions. Equal vectors are one class, searched once
    by its least vec_id; every member has the links of its class and the other members. Null, empty and zero
    vectors, and those with null or non-finite components, link with nothing; so do rows with a null vec_id. Of rows that
    share a vec_id, the one with the least label and vector counts. component_id is the least vec_id reachable.
    """
    classes, members = vector_classes(rows)
    links, measured = similar_vectors(classes.select("vec_id", "label", "dim", "vec"), threshold, **options)
    both = links.select("u", "v").union(links.select("v", "u")).toDF("class", "vec_id")
    weights = classes.select("vec_id", "weight")
    beyond = both.join(weights, "vec_id").groupBy("class").agg(F.sum("weight").alias("beyond"))
    known = components(links.toDF("a", "b")).withColumnRenamed("node", "class")
    found = weights.withColumnRenamed("vec_id", "class").join(beyond, "class", "left").join(known, "class", "left").select(
        "class", (F.col("weight") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component")
    )
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(members.join(found, "class").drop("class"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(measured).alias("audit_recall")
    )


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
component AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, coalesce(k.component, e.vec_id) AS component_id,
  coalesce(k.component, e.vec_id) = e.vec_id AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings e LEFT JOIN component k ON k.node = e.vec_id"""
