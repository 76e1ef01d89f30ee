"""What several operators share: tables, staging, files of tasks, words and their hashes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from hindcast.session import scratch_folder

#: Spark's setting that removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are the longest runs of characters outside this ASCII white space, in every operator.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes up to which words are hashed together.
LONG_WORD = 64


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python a thousand at a time: texts make Spark's default of 10,000 rows a large batch."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared scratch folder and read it back.

    This cuts the lineage: several consumers share one computation, and a lost executor costs a
    re-read of files.
    """
    spark, path = df.sparkSession, folder or scratch_folder(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of a finished write again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shards(docs: DataFrame, column: str, shard_bytes: int) -> int:
    """How many shards keep the text of one near ``shard_bytes``; no fewer than the shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // shard_bytes + 1)


# Files that tasks write and read themselves, on any file system that pyarrow knows.


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class TaskFile:
    """A file that appears under its final name only when closed in good order.

    Each attempt of a task writes under a name of its own; the rows a task returns name the file, so
    that only files of attempts that Spark accepted are ever read.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.system, base = file_system(folder)
        self.system.create_dir(base, recursive=True)
        self.final, self.partial = f"{base}/{self.name}", f"{base}/_{self.name}.partial"
        self.out, self.size = self.system.open_output_stream(self.partial, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.partial, self.final)


def open_file(folder: str, name: str) -> pa.NativeFile:
    system, base = file_system(folder)
    return system.open_input_file(f"{base}/{name}")


# Words.


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a finaliser of two multiplications)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def split_flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Row offsets into the words of all rows, and the words. Null rows have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return offsets, flat.filter(full)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The same, the words with their dictionary."""
    offsets, words = split_flat(texts, lower)
    return offsets, words.dictionary_encode()


def word_hashes(words: pa.DictionaryArray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; computed once per distinct word."""
    values = words.dictionary.cast(pa.large_binary()).to_pylist()
    table_ = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in values), np.uint64, len(values))
    return table_[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def flat_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of a large_string array without nulls, eight bytes of all words at a time.

    For words that are seldom repeated, where a dictionary gains nothing. The few above ``LONG_WORD``
    bytes are hashed one by one.
    """
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    start, length = offsets[:-1], np.diff(offsets)
    data = np.zeros(offsets[-1] + 8, np.uint8)  # the last word, too, has eight bytes from its start
    if offsets[-1]:
        data[:-8] = np.frombuffer(words.buffers()[2], np.uint8, offsets[-1])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = mix(mix(length.astype(np.uint64) + np.uint64(seed)) ^ (eight[start] & mask[np.minimum(length, 8)]))
    rows = np.flatnonzero((length > 8) & (length <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        rows = rows[length[rows] > at]
        out[rows] = mix(out[rows] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[start[rows] + at] & mask[np.minimum(length[rows] - at, 8)]))
    for row in np.flatnonzero(length > LONG_WORD).tolist():
        out[row] = xxhash.xxh3_64_intdigest(data[start[row] : start[row] + length[row]], seed)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def window_hashes(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every run of ``width`` consecutive values, in linear time.

    Prefix sums of h[i] * base**i modulo 2**64, brought to a common power by the inverse of base.
    Runs over ends of rows are the caller's to leave out.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, n), dtype=np.uint64)])
    inverse = pow(base, -1, 1 << 64)
    return mix((total[width:] - total[:-width]) * powers(inverse, n - width + 1))


def whole_hashes(hashes: np.ndarray, offsets: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of the whole sequence of each row, its length mixed in."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)), dtype=np.uint64)])
    inverse = powers(pow(base, -1, 1 << 64), len(hashes) + 1)
    lengths = np.diff(offsets).astype(np.uint64)
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]] + mix(lengths + np.uint64(1)))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each flat position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def parts_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that is larger than ``most`` bytes; a single row is never cut."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def release() -> None:
    """Give what a task has freed back to the system: Python workers live on, and so would its pages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks_of(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.Table]:
    """Batches of a task joined until they hold about ``most`` bytes, so that dictionaries are shared.

    When the last block has been taken, the memory of the others is released.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (part for whole in batches for part in parts_of(whole, most)):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    release()


def annotated(docs: DataFrame, added: dict[str, pa.DataType], compute) -> DataFrame:
    """``docs`` with columns that ``compute`` makes of blocks of its rows, in one pass without a shuffle.

    ``added`` has the Arrow type of each; columns of the same names are replaced. ``compute`` takes a
    table with all columns of ``docs`` and returns the new arrays in order.
    """
    kept = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            new = [a.cast(t) for a, t in zip(compute(block), added.values(), strict=True)]
            old = [block.column(names.index(f.name)) for f in kept]
            yield from pa.Table.from_arrays([*old, *new], names=[*(f.name for f in kept), *added]).to_batches(max_chunksize=2000)

    schema = T.StructType(list(kept))
    for name, kind in added.items():
        schema = schema.add(name, from_arrow_type(kind))
    return docs.mapInArrow(run, schema)
