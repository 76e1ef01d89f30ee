"""Mixing sources to target weights by fitting word budgets exactly.

Documents are counted by exact length within their source. A source's budget is whole passes over it
plus a remainder; the remainder is spread over the lengths in proportion and its last words are hit by a
bounded-knapsack table over the lengths' counts. Which documents of a length are taken is decided by a
seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import stage

#: Sums that the knapsack table covers, in words.
TABLE_WORDS = 1 << 16
#: Rows of one (source, length, hash range) that a task ranks.
CELL_ROWS = 20_000


def word_count(text: Column) -> Column:
    """The number of words; of a null text 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of ``totals`` (source, source_size): ``weights`` repeat over sources by code point, null last.

    Together they are ``share`` of all sizes; none is above ``most`` times its source. What a cap cuts off
    goes to the others by weight, until none is above: with sources in the order of most * size / weight, a
    prefix is capped and the rest share what is left. One row a source meets in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = totals.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    rows = rows.withColumns(
        {
            "budget": F.lit(share) * F.sum("source_size").over(all_rows),
            "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "open": F.sum("weight").over(rest),
        }
    )
    # Were this source's level the water level, all sources together would get this much.
    reached = F.col("capped") + F.col("level") * F.col("open") >= F.col("budget")
    level = F.min(F.when(reached, F.struct("level", F.least(F.col("level"), (F.col("budget") - F.col("capped")) / F.col("open")).alias("at")))).over(all_rows)
    rows = rows.withColumn("at", F.coalesce(level.getField("at"), F.lit(float("inf"))))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("at")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, table_words: int = TABLE_WORDS, complement: bool = True) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget`` or next to it.

    The proportional pass leaves a reserve of the shorter lengths for the table, so that the table nearly
    always hits the last word. Where it cannot, the sum differs by less than the shortest document left, or, if
    what is left is longer than ``table_words``, by less than a document. More than half is also fitted by what
    it leaves (``complement``), and the nearer of both taken.
    """
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if 2 * budget > total and complement:  # the documents left out are fewer: fit those, unless that is farther off
        both = counts - fit(lengths, counts, max(0, total - budget), table_words), fit(lengths, counts, min(budget, total), table_words, False)
        return min(both, key=lambda taken: abs(budget - int((taken * lengths).sum())))
    small = lengths[(lengths > 0) & (lengths <= table_words // 4)]
    reserve = min(budget, 2 * int(small.max())) if len(small) else 0
    goal, seen = budget - reserve, 0
    taken = 0
    for k in order:
        length, n = int(lengths[k]), int(counts[k])
        if not length:
            continue
        seen += length * n
        # Words due up to here, in whole numbers: goal * seen / total.
        out[k] = min(n, max(0, (goal * seen // total - taken) // length))
        taken += int(out[k]) * length
    # Long documents that still fit, then the table over what is left.
    for k in order:
        length = int(lengths[k])
        if length and budget - taken > table_words:
            more = min(int(counts[k] - out[k]), (budget - taken) // length)
            out[k] += more
            taken += more * length
    room = min(budget - taken, table_words)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    last = np.full(room + 1, -1, np.int64)
    items: list[tuple[int, int, int]] = []
    for k in order[::-1]:
        length, left, part = int(lengths[k]), int(counts[k] - out[k]), 1
        left = min(left, room // length) if length else 0
        while left and not reached[room]:
            part = min(part, left)
            size = part * length
            new = np.flatnonzero(reached[: room + 1 - size] & ~reached[size:]) + size
            reached[new] = True
            last[new] = len(items)
            items.append((int(k), part, size))
            left -= part
            part *= 2
    at = int(np.flatnonzero(reached).max())
    while at:
        k, part, size = items[last[at]]
        out[k] += part
        at -= size
    return out


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, table_words: int = TABLE_WORDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Every document is taken floor or ceiling of (budget / source size) times; ``taken`` is copies times
    size. Only lengths and hashes are shuffled. Choice within a (source, length) is by the rank of a hash of
    identifier and text; ranks are made in hash ranges of bounded size, so that one length may hold any
    number of documents. Null sources are one source; null and empty texts have size 0 and copies like
    any other of their source's passes; equal rows may change places. No rows give no rows.
    """
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text")).alias("hash"),
        )
    )
    lengths = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stage(source_targets(totals, weights, share, most))

    def choose_source(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size").reset_index(drop=True)
        total, budget = int(frame.source_size[0]), int(round(frame.target[0]))
        passes, rest = divmod(budget, total) if total else (0, 0)
        frame["passes"] = passes
        frame["extra"] = fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), rest, table_words)
        return frame[["source", "size", "source_size", "target", "passes", "extra"]]

    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    with_target = lengths.join(targets, same(lengths, targets, "source")).select(lengths["*"], targets.source_size, targets.target)
    chosen = stage(
        with_target.groupBy("source").applyInPandas(choose_source, "source string, size long, source_size long, target double, passes long, extra long")
    )
    largest = lengths.agg(F.max("n")).first()[0] or 1
    ranges = -(-largest // cell_rows)
    rows = rows.withColumn("range", F.pmod(F.shiftright("hash", 20), F.lit(ranges)))
    cell = ["source", "size", "range"]
    before = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = cells.join(chosen, same(cells, chosen, "source", "size")).select(*[cells[c] for c in (*cell, "start")], "source_size", "target", "passes", "extra")
    quota = stage(quota)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "doc_id")) - 1)
    joined = ranked.join(quota, same(ranked, quota, *cell))
    copies = F.col("passes") + F.when(F.col("start") + F.col("rank") < F.col("extra"), 1).otherwise(0)
    return joined.select(
        ranked.doc_id, ranked.source, ranked["size"], "source_size", "target", copies.alias("copies"), (copies * ranked["size"]).alias("taken")
    )
