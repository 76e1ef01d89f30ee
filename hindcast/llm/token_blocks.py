"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of many documents one after another, in blocks of ``BLOCK`` ids. Each block
subtracts its minimum and packs the differences at the width that holds a chosen percentile of them;
the high bits of larger ones follow as an exception list. The footer has the start of every block and
the document lengths, so that a reader finds any span of ids without unpacking what lies before it.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.session import scratch_folder

BLOCK = 8192
#: Text whose words are looked up together: what a task holds beside the vocabulary is some thirty times that.
BLOCK_BYTES = 2 << 20
PERCENTILE = 95.0
MAGIC = b"PFRBLK01"
#: A block's minimum, width, number of exceptions and number of ids.
HEAD = struct.Struct("<IBHH")
#: Documents, blocks, ids, start of the footer.
TAIL = struct.Struct("<QQQQ8s")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65,535 ids below 2**32."""
    least = int(ids.min())
    rest = (ids - np.uint32(least)).astype(np.uint32)
    at = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]
    high = (rest[odd] >> np.uint32(width)).astype("<u4")
    return HEAD.pack(least, width, len(odd), len(ids)) + np.packbits(bits).tobytes() + odd.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    least, width, odd, n = HEAD.unpack_from(data)
    packed = -(-n * width // 8)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, packed, HEAD.size), count=n * width).reshape(n, width)
    ids = np.packbits(bits).view(">u4").astype(np.uint32)
    at = HEAD.size + packed
    places = np.frombuffer(data, "<u2", odd, at)
    ids[places] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(width)
    return ids + np.uint32(least)


class BlockWriter:
    """Appends documents to one file."""

    def __init__(self, out: common.TaskFile, percentile: float = PERCENTILE):
        self.out, self.percentile = out, percentile
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.starts, self.doc_ids, self.known, self.lengths = [], [], [], []
        out.write(MAGIC)

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, known: np.ndarray) -> None:
        """Ids of several documents in a row, their lengths and identifiers."""
        self.lengths.append(lengths.astype("<i8"))
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.known.append(known.astype(np.uint8))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 32 * BLOCK:
            self.flush(self.n_held // BLOCK * BLOCK)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for at in range(0, upto, BLOCK):
            self.starts.append(self.out.size)
            self.out.write(pack_block(ids[at : min(at + BLOCK, upto)], self.percentile))
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> tuple[int, int]:
        """Write the footer; documents and ids of the file."""
        self.flush(self.n_held)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<i8")
        footer = self.out.size
        for part in (np.array([*self.starts, footer], "<i8"), lengths, *map(np.concatenate, (self.doc_ids, self.known) if self.lengths else ())):
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(len(lengths), len(self.starts), int(lengths.sum()), footer, MAGIC))
        self.out.close()
        return len(lengths), int(lengths.sum())


class BlockReader:
    """One file: its documents, and any span of its ids."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        source.seek(size - TAIL.size)
        docs, blocks, self.n_ids, footer, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token blocks, or cut off")
        source.seek(footer)
        data = source.read(size - TAIL.size - footer)
        self.starts = np.frombuffer(data, "<i8", blocks + 1)
        self.lengths = np.frombuffer(data, "<i8", docs, 8 * (blocks + 1))
        self.doc_ids = np.frombuffer(data, "<i8", docs, 8 * (blocks + 1 + docs))
        self.known = np.frombuffer(data, np.uint8, docs, 8 * (blocks + 1 + 2 * docs))

    def blocks(self, first: int = 0) -> Iterator[np.ndarray]:
        for k in range(first, len(self.starts) - 1):
            self.source.seek(int(self.starts[k]))
            yield unpack_block(self.source.read(int(self.starts[k + 1] - self.starts[k])))

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; reads only the blocks they lie in."""
        out, skip = [], start % BLOCK
        for ids in self.blocks(start // BLOCK):
            out.append(ids[skip : skip + n - sum(map(len, out))])
            skip = 0
            if sum(map(len, out)) >= n:
                break
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn, with one block more in memory than the document needs."""
        source = self.blocks()
        held = np.zeros(0, np.uint32)
        for n in self.lengths.tolist():
            parts, have = [held[:n]], min(n, len(held))
            held = held[n:]
            while have < n:
                ids = next(source)
                parts.append(ids[: n - have])
                held = ids[n - have :]
                have += len(parts[-1])
            yield np.concatenate(parts)


#: Words taken apart by their characters: below U+0300 nothing composes, and lowering maps each character by
#: itself (into this range, but for the two left out beside the dotted capital I).
PLAIN = "^[\\x{21}-\\x{26}\\x{28}-\\x{84}\\x{A1}-\\x{12F}\\x{131}-\\x{239}\\x{23B}-\\x{23D}\\x{23F}-\\x{2FF}]+$"
#: Letters are 1, numbers 2, other characters 3.
KINDS = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x300)], np.uint8)


def split_pieces(words: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Offsets into the pieces of all words, and the pieces: runs of letters, single numbers, runs of others.

    As the vocabulary's pre-tokeniser cuts ``PLAIN`` words, which are not empty and have no apostrophe.
    """
    if not len(words):
        return np.zeros(1, np.int64), words
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    first, last = int(bounds[0]), int(bounds[-1])
    data = np.frombuffer(words.buffers()[2], np.uint8)[first:last]
    kinds = KINDS[data]
    leads = np.flatnonzero(data >= 0xC0)
    kinds[leads] = KINDS[(data[leads] & np.uint8(0x1F)).astype(np.int64) << 6 | data[leads + 1] & np.uint8(0x3F)]
    kinds[leads + 1] = kinds[leads]
    begins = kinds == 2
    begins[1:] |= kinds[1:] != kinds[:-1]
    begins[leads + 1] = False
    begins[bounds[:-1] - first] = True
    starts = np.append(np.flatnonzero(begins), last - first)
    offsets = np.searchsorted(starts, bounds - first)
    return offsets, pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts + first), words.buffers()[2])


class WordEncoder:
    """The ids of distinct words, by a tokenizer whose pieces never cross white space.

    A text's ids are those of its words in turn, and a plain word's ids those of its pieces, so that each
    distinct word of a block is taken apart once and each distinct piece encoded once; ids of the first
    ``KNOWN`` pieces are remembered over blocks. Pieces are joined into long lines: they are lowered
    beforehand, which leaves the normaliser without work, the lines are cut at white space, and the ids of
    a piece end at the end-of-word mark. Other words go through the whole tokenizer one by one.
    """

    #: Pieces joined into one line, lines encoded at a time, and pieces (some ten MB) whose ids are remembered.
    LINE, LINES, KNOWN = 1000, 16, 1 << 18

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known, self.starts, self.ids = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encoded(self, texts: list[str], steps: tuple) -> Iterator[list[int]]:
        """The ids of each text, by a normaliser and a pre-tokeniser; few texts at a time, as encodings are large."""
        for at in range(0, len(texts), self.LINES):
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
            for e in self.tokenizer.encode_batch_fast(texts[at : at + self.LINES], add_special_tokens=False):
                yield e.ids

    def encode_new(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets into the ids of lowered pieces, and the ids."""
        cuts = np.append(np.arange(0, len(pieces), self.LINE), len(pieces))
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), pieces), pa.scalar("\n", pa.large_string())).to_pylist()
        counts, out = [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        for at, upto, found in zip(cuts, cuts[1:], self.encoded(lines, self.bare), strict=False):
            ids = np.array(found, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != upto - at or ends[-1] != len(ids):  # cut otherwise than foreseen: the plain way
                single = list(self.encoded(pieces[at:upto].to_pylist(), self.whole))
                ids, ends = np.array([i for s in single for i in s], np.uint32), np.cumsum([len(s) for s in single])
            counts.append(np.diff(ends, prepend=0))
            out.append(ids)
        return np.cumsum(np.concatenate(counts)), np.concatenate(out)

    def encode_pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct lowered piece begin and how many they are, and the ids."""
        rows = pc.index_in(pieces, value_set=self.known)
        new = rows.is_null()
        fresh = pieces.filter(new)
        starts, ids = self.encode_new(fresh)
        starts, ids = np.concatenate([self.starts, self.starts[-1] + starts[1:]]), np.concatenate([self.ids, ids])
        rows, new = rows.fill_null(0).to_numpy().astype(np.int64), new.to_numpy(zero_copy_only=False)
        rows[new] = len(self.known) + np.arange(len(fresh))
        kept = min(self.KNOWN, int(np.searchsorted(starts, 8 * self.KNOWN, "right")) - 1)  # few of them, if long
        if kept > len(self.known):
            self.known = pa.concat_arrays([self.known, fresh[: kept - len(self.known)]])
            self.starts, self.ids = starts[: kept + 1].copy(), ids[: starts[kept]].copy()
        return starts[rows], np.diff(starts)[rows], ids

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets into the ids of all words, and the ids."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        of_word, pieces = split_pieces(pc.utf8_lower(words.filter(plain)).cast(pa.large_string()))
        pieces = pieces.dictionary_encode()
        starts, sizes, known = self.encode_pieces(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        sizes = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(sizes)])[of_word]
        plain = plain.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.diff(upto)
        rest = np.flatnonzero(~plain)
        single = list(self.encoded(words.take(pa.array(rest)).to_pylist(), self.whole))
        counts[rest] = [len(s) for s in single]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offsets[-1], np.uint32)
        out[ragged(offsets[:-1][plain], counts[plain])] = known[ragged(starts[codes], sizes)]
        out[ragged(offsets[:-1][rest], counts[rest])] = np.array([i for s in single for i in s], np.uint32)
        return offsets, out


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process, which reads the vocabulary for its first task only."""
    return WordEncoder(path)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + counts[i] - 1 for every i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def encode_texts(encoder: WordEncoder, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with ``end_id`` after each, and the lengths with it."""
    rows, words = common.split_words(texts)
    starts, ids = encoder.encode(words.dictionary)
    codes = words.indices.to_numpy()
    counts = np.diff(starts)[codes]
    flat = ids[ragged(starts[codes], counts)]
    upto = np.concatenate([[0], np.cumsum(counts)])[rows]
    lengths = np.diff(upto)
    out = np.full(len(flat) + len(lengths), end_id, np.uint32)
    out[ragged(upto[:-1] + np.arange(len(lengths)), lengths)] = flat
    return out, lengths + 1


MANIFEST = "file string, part int, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", percentile: float = PERCENTILE) -> DataFrame:
    """Encode ``text`` of all rows into files under ``path`` in ascending ``key`` order.

    Rows are dealt by ranges of the key, so that file follows file; each task encodes its range block by
    block and writes one file. The table ``path``/manifest, one row a file, is the commit: files that no
    row names come from attempts that were lost. A null text is empty; a null key comes first; equal
    keys stay together, ordered by text. Repeated rows are written repeatedly. No rows, no files.
    Returns the manifest with the position of each file's first id (``start``).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, out = None, None, None
        part = TaskContext.get().partitionId()
        for block in common.blocks_of(batches, BLOCK_BYTES):
            if not block.num_rows:
                continue
            if writer is None:
                encoder, out = word_encoder(tokenizer), common.TaskFile(path, f"ids-{part:06d}", ".pfr")
                writer = BlockWriter(out, percentile)
            keys = block["key"].combine_chunks()
            ids, lengths = encode_texts(encoder, block["text"].combine_chunks(), end_id)
            writer.add(ids, lengths, keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"file": out.name, "part": part, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    common.stage(ordered.mapInArrow(write, MANIFEST), f"{path}/manifest")
    return read_manifest(docs.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; their number does not grow with documents but with partitions."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Read the files back, one task a file: doc_id, start, n_tokens and the ids.

    With ``digest`` the ids are left out for their crc32 (as little-endian unsigned 32-bit integers).
    """
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with common.open_file(path, row["file"]) as source:
                    reader = BlockReader(source)
                    starts = row["start"] + np.cumsum(reader.lengths) - reader.lengths
                    values, at, size = [], 0, 0
                    for k, ids in enumerate(reader.documents()):
                        values.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64))
                        size += 1 if digest else len(ids)
                        if size >= 1 << 17 or k + 1 == len(reader.lengths):
                            cut = slice(at, k + 1)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(reader.doc_ids[cut], mask=reader.known[cut] == 0), pa.array(starts[cut]), pa.array(reader.lengths[cut]), pa.array(values, last[1])],
                                schema=schema,
                            )
                            values, at, size = [], k + 1, 0

    files = read_manifest(spark, path).select("file", "start")
    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` to the scratch folder and describe each document from them."""
    spark = docs.sparkSession
    path = scratch_folder(spark)
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path, digest=True)
