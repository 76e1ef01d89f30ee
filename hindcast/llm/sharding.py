"""A reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get gapless numbers in the order of their columns; a keyed permutation of 0 .. n-1 gives each its
place, and place modulo the number of shards its shard. Nobody needs the table to answer which shard and
slot a row number has, or which row number lies at a shard and slot: both are computed.
DataFrame expressions only.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import stage

ROUNDS = 6
#: Steps of a cycle walk before a row fails loudly. A step misses with a chance of at most
#: (a*a - n) / (a*a), about 2 / sqrt(n), and a walk has at most a*a - n of them.
WALK = 96


def side(n: int) -> int:
    """The least a with a * a >= n: both halves of the network run over 0 .. a-1."""
    return max(1, math.isqrt(max(n, 1) - 1) + 1)


def round_key(seed: int, i: int) -> str:
    return f"{seed}:{i}:"


def _round(value: Column, seed: int, i: int, a: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(round_key(seed, i)), value.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") % F.lit(a)


def _network(value: Column, n: int, seed: int, inverse: bool = False) -> Column:
    a = side(n)
    left, right = (value / F.lit(a)).cast("long"), value % F.lit(a)
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if inverse:
            left, right = F.pmod(right - _round(left, seed, i, a), F.lit(a)), left
        else:
            left, right = right, (left + _round(right, seed, i, a)) % F.lit(a)
    return left * F.lit(a) + right


def permuted(value: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The place of row number ``value`` among ``n``, or with ``inverse`` the row number of a place."""
    if n > 1 << 52:
        raise ValueError("more rows than exact division covers")
    first = _network(value, n, seed, inverse)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        first,
        lambda x, _: F.when(x < F.lit(n), x).otherwise(_network(x, n, seed, inverse)),
    )
    done = F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walk too long; take another seed")).cast("long"))
    return F.when(first < F.lit(n), first).otherwise(done)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` as a struct column ``row`` with gapless global numbers ``row_number`` from 0, and their count.

    Ranges are sorted in parallel; each adds the rows of the ranges before it. The table of ranges has one
    row a partition, which bounds its broadcast.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stage(ranged.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")))
    # Spark puts the partition above bit 33 and the row within it below.
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    total = starts.agg(F.sum("n")).first()[0] or 0
    joined = held.withColumn("part", part).join(F.broadcast(starts.select("part", "start")), "part")
    return joined.select("row", (F.col("start") + local).alias("row_number")), total


def feistel_shards(rows: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    """Add ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in each shard) to ``rows``.

    Row counts of shards differ by at most one. ``order`` decides the row numbers; rows equal in all its
    columns may change places. Nulls are numbered first. Columns of ``rows`` named like the new ones are
    replaced. No rows give no rows.
    """
    numbers, n = numbered(rows, order)
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c not in ("shard", "slot")]
    place = numbers.withColumn("place", permuted(F.col("row_number"), n, seed))
    return place.select(*kept, (F.col("place") % shards).cast("int").alias("shard"), (F.col("place") / shards).cast("long").alias("slot"))


def locate(row_number: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of a row number, without the table."""
    place = permuted(row_number, n, seed)
    return (place % shards).cast("int"), (place / shards).cast("long")


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number at a shard and slot, without the table."""
    return permuted(slot * F.lit(shards) + shard, n, seed, inverse=True)


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 20240607) -> DataFrame:
    """Shards of documents under the law ``rows``.

    The size is the UTF-8 bytes of the text (null: none) plus one; the crc32 of a null text is that of an
    empty one. Only these narrow rows are shuffled, never the texts. Equal texts may lie in different
    shards: the law counts rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = feistel_shards(rows, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def document_shards_sql(shards: int = 16, seed: int = 20240607) -> str:
    """The same rows in DuckDB's SQL, the crc32 by its bitwise definition."""
    rounds = "".join(
        f", r{i + 1} AS (SELECT number, n, a, r AS l, (l + ('0x' || substr(md5('{round_key(seed, i)}' || r::VARCHAR), 1, 12))::BIGINT % a) % a AS r FROM r{i})"
        for i in range(ROUNDS)
    )
    return f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
polynomial AS (SELECT list(v ORDER BY k) AS t FROM (
  WITH RECURSIVE s AS (SELECT range AS k, range::BIGINT AS v, 0 AS i FROM range(256)
    UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM s WHERE i < 8)
  SELECT k, v FROM s WHERE i = 8)),
sums AS (SELECT doc_id, n + 1 AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT]))) AS text_crc32 FROM bytes, polynomial),
numbers AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number FROM sums),
total AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents),
domain AS (SELECT range AS number, n, a FROM total, range((SELECT ceil(sqrt(count(*)))::BIGINT * ceil(sqrt(count(*)))::BIGINT FROM documents))),
r0 AS (SELECT number, n, a, number // a AS l, number % a AS r FROM domain){rounds},
network AS (SELECT number, n, l * a + r AS image FROM r{ROUNDS}),
walk AS (SELECT number, n, image FROM network WHERE number < n
  UNION ALL SELECT w.number, w.n, k.image FROM walk w JOIN network k ON k.number = w.image WHERE w.image >= w.n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (image % {shards})::INT AS shard, image // {shards} AS slot, NULL::INT AS grown_shard
FROM numbers JOIN (SELECT number, image FROM walk WHERE image < n) USING (number)"""
