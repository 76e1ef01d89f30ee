"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised as its vocabulary asks, cut into chunks that no piece can cross, and each distinct
chunk is merged by an agenda: the adjacent pair of symbols that makes the piece of best score goes first,
the leftmost of equal ones before the others. What the agenda gives is compared with the sentencepiece
library for every chunk a task meets; a difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm import common
from hindcast.llm.token_blocks import ragged

#: The mark that stands for a space in pieces. Fixed value.
SPACE = "▁"
#: Chunks begin with a run of space marks; no piece of a supported vocabulary goes on over the next one.
CROSSING = re.compile(f"[^{SPACE}]{SPACE}")
#: A task remembers so many chunks before it starts anew; longer ones than so many characters are merged one by one.
REMEMBERED, LONGEST = 1_000_000, 48
#: Text of so many bytes is handled at once.
BLOCK_BYTES = 2 << 20


class Merger:
    """Symbols of a merge-type vocabulary and how they join.

    Symbols are numbers: the pieces by their ids, then every character that is no piece from the size of the
    vocabulary on. ``pairs`` has each two symbols that make a piece, ordered; beside them the place of that
    piece in the order of scores, and its id.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        one = self.library
        self.size = one.get_piece_size()
        pieces = {i: one.id_to_piece(i) for i in range(self.size)}
        special = lambda i: one.is_control(i) or one.is_unknown(i) or one.is_byte(i) or one.is_unused(i)
        self.known = {p: i for i, p in pieces.items() if not special(i)}
        self.bytes = {int(p[1:-1], 16): i for i, p in pieces.items() if one.is_byte(i)}
        if one.normalize("a") != f"{SPACE}a" or any(CROSSING.search(p) for p in self.known):
            raise ValueError("a vocabulary with space marks before words and none inside pieces is needed")
        joins = [(self.known[p[:k]], self.known[p[k:]], i) for p, i in self.known.items() for k in range(1, len(p)) if p[:k] in self.known and p[k:] in self.known]
        left, right, made = (np.array(x, np.int64) for x in zip(*joins, strict=True))
        scores = np.array([-one.get_score(i) for i in made.tolist()])
        order = np.argsort(left * self.size + right)
        self.pairs = (left * self.size + right)[order]
        self.places = np.unique(scores, return_inverse=True)[1].astype(np.int32)[order]  # equal scores share a place
        self.made = made[order].astype(np.int32)
        self.of_point = np.arange(self.size, self.size + sys.maxunicode + 1, dtype=np.int32)
        for piece, i in self.known.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
        self.joins = dict(zip(self.pairs.tolist(), zip(self.places.tolist(), self.made.tolist(), strict=True), strict=True))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair of symbols in ``pairs``, or -1."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left < self.size) & (right < self.size), at, -1)

    def symbols(self, chunk: str) -> list[int]:
        return [self.known.get(c, self.size + ord(c)) for c in chunk]

    def ids(self, symbols: list[int]) -> list[int]:
        """Ids of merged symbols: characters that are no piece become their bytes, or one unknown id a run."""
        out: list[int] = []
        for symbol in symbols:
            if symbol < self.size:
                out.append(symbol)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(symbol - self.size).encode())
            elif not out or out[-1] != self.library.unk_id():
                out.append(self.library.unk_id())
        return out

    def merge_long(self, chunk: str) -> list[int]:
        """Merge one chunk of any length, its agenda a heap of (place, position, right end, piece)."""
        symbols, size, joins = self.symbols(chunk), self.size, self.joins
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        find = lambda a, b: joins.get(symbols[a] * size + symbols[b]) if symbols[a] < size and symbols[b] < size else None
        agenda = [(found[0], at, at + 2, found[1]) for at in range(end - 1) if (found := find(at, at + 1))]
        heapq.heapify(agenda)
        while agenda:
            _, left, upto, piece = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] < 0 or right >= end or after[right] != upto or joins.get(symbols[left] * size + symbols[right], (0, -1))[1] != piece:
                continue  # one of its symbols has been joined to another since
            symbols[left], symbols[right], after[left] = piece, -1, upto
            if upto < end:
                before[upto] = left
                if found := find(left, upto):
                    heapq.heappush(agenda, (found[0], left, after[upto], found[1]))
            if before[left] >= 0 and (found := find(before[left], left)):
                heapq.heappush(agenda, (found[0], before[left], upto, found[1]))
        return self.ids([s for s in symbols if s >= 0])

    def merge_equal(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge many chunks of one length side by side; yields some of their indexes and rows of their symbols.

        A row of ``agenda`` has the place of each adjacent pair; every round takes the head of all rows, the
        first of equal places, and only the two pairs around it are looked up anew. A row is closed up by
        one symbol a round, rows without a pair leave.
        """
        none = np.int32(np.iinfo(np.int32).max)
        rows = np.arange(len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        now = self.of_point[points].reshape(len(chunks), -1)

        def places(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            at = self.look_up(left, right)
            return np.where(at >= 0, self.places[at], none)

        agenda = places(now[:, :-1], now[:, 1:])
        while len(rows):
            width = now.shape[1]
            head = agenda.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            done = agenda[np.arange(len(rows)), head] == none if width > 1 else np.ones(len(rows), bool)
            yield rows[done], now[done]
            rows, now, agenda, head = rows[~done], now[~done], agenda[~done], head[~done]
            if not len(rows):
                break
            each, columns = np.arange(len(rows)), np.arange(width - 1)
            piece = self.made[self.look_up(now[each, head], now[each, head + 1])]
            now = np.where(columns[None, :] <= head[:, None], now[:, :-1], now[:, 1:])
            now[each, head] = piece
            agenda = np.where(columns[None, :-1] < head[:, None], agenda[:, :-1], agenda[:, 1:])
            for side in (head - 1, head):
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                agenda[ok, side[ok]] = places(now[ok, side[ok]], now[ok, side[ok] + 1])

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some distinct chunks has, and the ids of all, one chunk after another."""
        order, counts, parts = [], [], []

        def add(rows: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
            order.append(rows)
            counts.append(n)
            parts.append(ids)

        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            equal = [chunks[k] for k in at.tolist()]
            if length > LONGEST:
                for k, chunk in zip(at, equal, strict=True):
                    ids = self.merge_long(chunk)
                    add(np.array([k]), np.array([len(ids)]), np.array(ids, np.int32))
                continue
            for rows, symbols in self.merge_equal(equal):
                odd = (symbols >= self.size).any(axis=1)
                add(at[rows[~odd]], np.full((~odd).sum(), symbols.shape[1]), symbols[~odd].ravel())
                for k, row in zip(at[rows[odd]], symbols[odd].tolist(), strict=True):
                    ids = self.ids(row)
                    add(np.array([k]), np.array([len(ids)]), np.array(ids, np.int32))
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        placed, n, flat = np.concatenate(order), np.concatenate(counts), np.concatenate(parts)
        back = np.argsort(placed)
        return n[back], flat[ragged((np.cumsum(n) - n)[back], n[back])]


class PieceEncoder:
    """Ids of texts, with a memory of the chunks met and a check of each by the library."""

    #: Chunks joined into one text for the check.
    LINE = 200

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.library = self.merger.library
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def check(self, chunks: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        """Compare chunks with the library, many joined into one text: no piece crosses their borders.

        Runs of marks alone would join the chunk after them; they are compared behind a word of their own.
        """
        upto = np.concatenate([[0], np.cumsum(counts)])
        of = lambda k: ids[upto[k] : upto[k + 1]].tolist()
        words = [k for k, c in enumerate(chunks) if c[-1] != SPACE]
        lines = [words[k : k + self.LINE] for k in range(0, len(words), self.LINE)]
        expected = self.library.encode(["".join(chunks[k] for k in line)[1:] for line in lines], num_threads=1)
        wrong = [line for line, found in zip(lines, expected, strict=True) if found != [i for k in line for i in of(k)]]
        word = self.library.encode("a")
        wrong += [[k] for k, c in enumerate(chunks) if c[-1] == SPACE and self.library.encode(f"a{c}") != word + of(k)]
        if wrong:
            raise ValueError(f"ids differ from the sentencepiece library's in {[chunks[k] for k in wrong[0]]}")

    def codes(self, chunks: list[str]) -> np.ndarray:
        """Places of distinct chunks in the memory; those that are new are merged and checked."""
        new = [c for c in chunks if c not in self.memory]
        counts, ids = self.merger.merge(new)
        self.check(new, counts, ids)
        self.memory.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, ids])
        return np.fromiter(map(self.memory.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, without an end id, and the ids of all.

        A normalised text is split at its space marks. A part and the mark before it are a chunk; where
        parts are empty, the marks run on into the chunk of the next one.
        """
        if len(self.memory) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self.forget()
        lists = pc.split_pattern(pa.array(self.library.normalize(texts), pa.large_string()), SPACE)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        place = np.arange(len(flat)) - bounds[:-1][row]
        kept = np.flatnonzero(place > 0)  # before the first mark is nothing
        row, part = row[kept], flat.indices.to_numpy()[kept]
        words = flat.dictionary.to_pylist()
        empty = np.array([not w for w in words], bool)[part]
        last = np.append(row[1:] != row[:-1], True)[: len(row)]
        ends = np.flatnonzero(~empty | last)  # the part that ends each chunk
        marks = np.diff(np.concatenate([[-1], ends]))
        plain, single = part[ends], np.flatnonzero(marks == 1)
        chunk = np.zeros(len(ends), np.int64)
        used = np.unique(plain[single])
        of_word = np.zeros(len(words) + 1, np.int64)
        of_word[used] = self.codes([SPACE + words[k] for k in used.tolist()])
        chunk[single] = of_word[plain[single]]
        several = np.flatnonzero(marks > 1)
        strings = [SPACE * m + words[k] for m, k in zip(marks[several].tolist(), plain[several].tolist(), strict=True)]
        distinct = dict.fromkeys(strings)
        known = dict(zip(distinct, self.codes(list(distinct)), strict=True))
        chunk[several] = np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))
        counts = self.counts[chunk]
        starts = np.cumsum(self.counts) - self.counts
        return np.bincount(row[ends], counts, len(texts)).astype(np.int64), self.flat[ragged(starts[chunk], counts)]


def ended(counts: np.ndarray, ids: np.ndarray, end_id: int) -> pa.ListArray:
    """Lists of ids with ``end_id`` after each."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end_id, np.int32)
    out[ragged(offsets[:-1], counts)] = ids
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for part in common.parts_of(batch, BLOCK_BYTES):
            yield part, ["" if t is None else t for t in part.column(column).to_pylist()]


def with_ids(docs: DataFrame, model: str, end_id: int, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of whole texts and ``end_id`` after them in a new array column.

    ``model`` is a path that every executor can open. Rows stay where they are: nothing is shuffled. A null
    text counts as empty and has the end id alone; null keys, repeated rows and other columns pass through;
    a column named like ``ids`` is replaced. No rows, no ids.
    """
    kept = [c for c in docs.columns if c != ids]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("_pieces_of"))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model)
        for part, texts in _blocks(batches, len(kept)):
            new = ended(*encoder.encode(texts), end_id)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], new], names=[*kept, ids])

    return rows.mapInArrow(run, schema)


def with_texts(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text that the library decodes from whole lists of ids; null from null.

    A column named like ``text`` is replaced.
    """
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*(F.col(f"`{c}`") for c in kept)).schema.add(text, "string")
    cast = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids}`").cast("array<int>").alias("_ids_of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model)
        for batch in batches:
            for part in common.parts_of(batch, BLOCK_BYTES):
                new = pa.array([None if i is None else library.decode(i) for i in part.columns[-1].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], new], names=[*kept, text])

    return cast.mapInArrow(run, schema)


def piece_digest(docs: DataFrame, model: str, end_id: int) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 of the decimal ids and decoded_sha256 of the decoded text.

    Encodes and decodes in one pass, so that the ids of a text exist only while its row is handled. One row
    for each row of ``docs``, whatever its key; a null text is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model)
        for part, texts in _blocks(batches, 1):
            ids = ended(*encoder.encode(texts), end_id)
            lengths = np.diff(ids.offsets.to_numpy())
            decimal = pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string()))
            codes = [hashlib.sha256(t.as_buffer()).hexdigest() for t in pc.binary_join(decimal, " ")]
            bounds, flat = ids.offsets.to_pylist(), ids.values.to_numpy()
            decoded = [hashlib.sha256(encoder.library.decode(flat[a:b].tolist()).encode()).hexdigest() for a, b in pairwise(bounds)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(codes, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
