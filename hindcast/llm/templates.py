"""Benchmark decontamination on templates.

Numbers, names and units become typed placeholders, so that a question asked again with other values keeps
its template. Template windows of the benchmark are looked up in every document; a hit stands only where
the values under the placeholders map consistently from the item to the document. Template windows of
mostly placeholders would match anything and are not looked up; every window is also looked up by its
words, so a verbatim passage is found whatever it is made of. Capitals are read in three ways, and a run of
names or numbers is one placeholder, so that names of other length, case or place in the sentence match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import stage

WINDOW = 8
#: Words of an item that must match in line: this many, or half of a shorter item.
COVER = 13
#: Half of an item means at least so many words; items with fewer are looked for whole and verbatim.
LEAST_WORDS = 5
#: Words of benchmark items that one pass over the documents looks for.
PASS_WORDS = 2_000_000
#: Words of documents that are looked up at a time.
PART_WORDS = 1 << 17

# Unit words.
UNITS = """m cm mm km kg g mg lb lbs oz l ml s ms min h hr hrs mph kph km/h m/s kw kwh mw w v a hz khz mhz ghz kb mb gb tb
inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers centimetre
centimetres centimeter centimeters gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters gallon
gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent
cents yen percent degree degrees celsius fahrenheit joule joules watt watts volt volts ampere amperes newton newtons""".split()

LITERAL, NUMBER, NAME, UNIT = range(4)
EMPTY = np.uint64(xxhash.xxh3_64_intdigest("", 3))
PLACEHOLDERS = [0, *(xxhash.xxh3_64_intdigest(x, 3) for x in ("<number>", "<name>", "<unit>"))]


#: How capitals are read: only inside sentences, at their beginning too, or by the word form whatever its case.
VIEWS = ("inside", "anywhere", "form")


@dataclass
class Words:
    """Canonical words of several texts: offsets, the hash of each word and its kind in each view."""

    offsets: np.ndarray
    values: np.ndarray
    kinds: dict[str, np.ndarray]
    #: Of each distinct word its hash, and how often it occurs capitalised inside a sentence and in lower case.
    forms: tuple[np.ndarray, np.ndarray, np.ndarray]


def canonical(texts: pa.Array, names: np.ndarray) -> Words:
    """Canonical words; each distinct word is looked at once. ``names`` are the sorted hashes of name forms.

    A word with digits and no letters besides a unit is a number and a unit word a unit. Case and surrounding
    punctuation do not count.
    """
    offsets, words = common.split_words(texts)
    distinct = words.dictionary
    bare = pc.replace_substring_regex(distinct, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")
    lower = pc.utf8_lower(bare)
    flag = lambda pattern, of: pc.match_substring_regex(of, pattern).to_numpy(zero_copy_only=False)
    number = flag(r"^[0-9][0-9.,:/]*(%|[a-zµ°]{1,3})?$", lower)
    unit = pc.is_in(lower, value_set=pa.array(UNITS, lower.type)).to_numpy(zero_copy_only=False) & ~number
    title = flag(r"^\p{Lu}\p{Ll}+(['’-]\p{L}+)*$", bare) & ~unit
    ends = flag(r"[.!?:…][\"'”’)\]»]*$", distinct)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, 3) for w in lower.cast(pa.large_binary()).to_pylist()), np.uint64, len(lower))
    codes = words.indices.to_numpy() if len(words) else np.zeros(0, np.int64)
    begins = np.ones(len(codes), bool)
    begins[1:] = ends[codes[:-1]]
    begins[offsets[:-1][offsets[:-1] < len(codes)]] = True
    plain = np.where(number, NUMBER, np.where(unit, UNIT, LITERAL)).astype(np.uint8)
    known = np.where(isin_sorted(hashes, names) & (plain == LITERAL), NAME, plain).astype(np.uint8)
    kinds = {"anywhere": np.where(title, NAME, plain).astype(np.uint8)[codes], "form": known[codes]}
    kinds["inside"] = np.where(begins, plain[codes], kinds["anywhere"])
    small = pc.equal(bare, lower).to_numpy(zero_copy_only=False)
    inside = np.bincount(codes[title[codes] & ~begins], minlength=len(hashes))
    return Words(offsets, hashes[codes], kinds, (hashes, inside, np.bincount(codes, minlength=len(hashes)) * small))


def some_rows(words: Words, most: int = PART_WORDS) -> Iterator[Words]:
    """Parts of whole rows, of about ``most`` words: windows are hashed in many columns as long as the words."""
    begin, n = 0, len(words.offsets) - 1
    while begin < n:
        end = min(n, max(begin + 1, int(np.searchsorted(words.offsets, words.offsets[begin] + most, "right")) - 1))
        a, b = words.offsets[begin], words.offsets[end]
        yield Words(words.offsets[begin : end + 1] - a, words.values[a:b], {view: k[a:b] for view, k in words.kinds.items()}, words.forms)
        begin = end


def isin_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    at = np.searchsorted(among, values)
    return (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == values) if len(among) else np.zeros(len(values), bool)


@dataclass
class Template:
    """A view's tokens: runs of names and of numbers are one. Row offsets, template hashes, kinds, the hash of
    the words, where each token begins (and the end of all), and the token of each word."""

    offsets: np.ndarray
    tokens: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    of_word: np.ndarray


def template(words: Words, view: str) -> Template:
    kinds, n = words.kinds[view], len(words.values)
    first = np.ones(n, bool)
    first[1:] = (kinds[1:] != kinds[:-1]) | ((kinds[1:] != NAME) & (kinds[1:] != NUMBER))
    first[words.offsets[:-1][words.offsets[:-1] < n]] = True
    starts = np.flatnonzero(first)
    of_word = np.cumsum(first) - 1
    place = np.arange(n) - starts[of_word] if n else np.zeros(0, np.int64)
    powers = common.powers(0x9E3779B97F4A7C15, int(place.max()) + 1 if n else 1)
    values = np.add.reduceat(words.values * powers[place], starts) if n else words.values
    kinds = kinds[starts]
    tokens = np.where(kinds == LITERAL, values, np.array(PLACEHOLDERS, np.uint64)[kinds])
    ends = np.append(starts, n)
    return Template(np.searchsorted(ends, words.offsets), tokens, kinds, values, ends, of_word)


@dataclass
class Windows:
    """Template windows of benchmark items of one width, sorted by hash."""

    width: int
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    present: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, keep: np.ndarray, rows: np.ndarray, width: int) -> Windows:
        keep = keep[np.argsort(hashes[keep], kind="stable")]
        present = np.zeros(1 << 20, bool)
        present[(hashes[keep] >> np.uint64(44)).astype(np.int64)] = True
        return cls(width, hashes[keep], rows[keep], keep, present)

    def hits(self, hashes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` and entries of this table that agree."""
        places = np.flatnonzero(inside & self.present[(hashes >> np.uint64(44)).astype(np.int64)])
        low, high = (np.searchsorted(self.hashes, hashes[places], side) for side in ("left", "right"))
        n = high - low
        ends = np.cumsum(n)
        return np.repeat(places, n), np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(low, n)


def inside_rows(offsets: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the windows lie in one row."""
    rows = common.row_of(offsets)
    return rows[: max(0, n - width + 1)] == rows[width - 1 :] if n >= width else np.zeros(0, bool)


class Benchmark:
    """Templates of some items and their windows: by template tokens of each view, and by words."""

    def __init__(self, item_ids: list, texts: pa.Array, window: int = WINDOW, cover: int = COVER, least_words: int = LEAST_WORDS, names: np.ndarray | None = None):
        if names is None:  # those of the items
            names = names_of(*canonical(texts, np.zeros(0, np.uint64)).forms)
        self.item_ids, self.names, self.w = item_ids, names, canonical(texts, names)
        lengths = np.diff(self.w.offsets)
        self.cover = np.where(lengths < least_words, lengths, np.minimum(cover, np.maximum(least_words, -(-lengths // 2))))
        rows = common.row_of(self.w.offsets)
        told = np.bincount(rows[self.w.values != EMPTY], minlength=len(lengths)) > 0  # not punctuation alone
        widths = np.where(told, np.minimum(window, self.cover), 0)
        self.verbatim = []
        for width in sorted(set(widths.tolist()) - {0}):
            inside = inside_rows(self.w.offsets, len(rows), width)
            keep = np.flatnonzero(inside & (widths[rows[: len(inside)]] == width))
            self.verbatim.append(Windows.of(common.window_hashes(self.w.values, width), keep, rows, width))
        self.views = {view: template(self.w, view) for view in VIEWS}
        self.windows = {view: self.template_windows(t, np.where(lengths >= least_words, widths, 0)) for view, t in self.views.items()}

    @staticmethod
    def template_windows(t: Template, words: np.ndarray) -> list[Windows]:
        """Runs of tokens of at least so many words of the item, the shortest from each token on and up to each.

        At least half of the tokens, and three, are literal.
        """
        rows = common.row_of(t.offsets)
        n, asked = len(rows), words[rows]
        after = np.searchsorted(t.starts, t.starts[:-1] + asked)
        before = np.searchsorted(t.starts, t.starts[1:] - asked, side="right") - 1
        begin = np.concatenate([np.arange(n), before])
        end = np.concatenate([after, np.arange(1, n + 1)])
        of = np.concatenate([rows, rows])
        keep = (np.concatenate([asked, asked]) > 0) & (begin >= t.offsets[of]) & (end <= t.offsets[of + 1])
        begin, end = np.unique(np.stack([begin[keep], end[keep]]), axis=1) if keep.any() else (begin[:0], end[:0])
        literal = np.concatenate([[0], np.cumsum(t.kinds == LITERAL)])
        literal = literal[end] - literal[begin]
        keep = (2 * literal >= end - begin) & (literal >= 3)
        begin, width = begin[keep], (end - begin)[keep]
        return [Windows.of(common.window_hashes(t.tokens, k), begin[width == k], rows, k) for k in sorted(set(width.tolist()))]

    def leaks(self, texts: pa.Array) -> list[dict[int, bool]]:
        """Of every text the items that it repeats (by index), and whether with other values."""
        return [found for part in some_rows(canonical(texts, self.names)) for found in self.leaks_of(part)]

    def leaks_of(self, w: Words) -> list[dict[int, bool]]:
        """The same of texts taken apart."""
        out: list[dict[int, bool]] = [{} for _ in range(len(w.offsets) - 1)]
        verbatim: dict[tuple[int, int, int], list] = {}
        for row, item, shift, at, width in self.found(self.verbatim, w.values, w.offsets, True, out):
            verbatim.setdefault((row, item, shift), []).append((at, width))
        for (row, item, _), spans in verbatim.items():
            if len({p for a, n in spans for p in range(a, a + n)}) >= self.cover[item]:
                out[row][item] = False  # a verbatim passage is no changed one
        for view, own in self.views.items():
            t = template(w, view)
            groups: dict[tuple[int, int, int], list] = {}
            for row, item, shift, at, width in self.found(self.windows[view], t.tokens, t.offsets, False, out):
                groups.setdefault((row, item, shift), []).append((at, width))
            same: dict[tuple[int, int, int], set] = {}
            for (row, item, shift), spans in verbatim.items() if groups else ():
                for a, n in spans:
                    same.setdefault((row, item, int(t.of_word[a] - own.of_word[a - shift])), set()).update(range(a, a + n))
            for (row, item, shift), spans in groups.items():
                if item not in out[row] and self.covered(own, t, shift, spans, same.get((row, item, shift), ())) >= self.cover[item]:
                    out[row][item] = True
        return out

    def found(self, tables: list[Windows], of: np.ndarray, offsets: np.ndarray, by_words: bool, out: list[dict[int, bool]]):
        """Row, item, shift, place and width of the windows found. One window of words may be all that is asked for."""
        rows = common.row_of(offsets)
        for table in tables:
            places, entries = table.hits(common.window_hashes(of, table.width), inside_rows(offsets, len(of), table.width))
            row, item, shift = rows[places], table.item[entries], places - table.at[entries]
            if by_words:
                whole = self.cover[item] <= table.width
                n = max(1, len(self.cover))
                for key in np.unique(row[whole] * n + item[whole]).tolist():
                    out[key // n][key % n] = False
                row, item, shift, places = (x[~whole] for x in (row, item, shift, places))
            for r, i, s, at in zip(row.tolist(), item.tolist(), shift.tolist(), places.tolist(), strict=True):
                yield r, i, s, at, table.width

    @staticmethod
    def covered(own: Template, t: Template, shift: int, spans: list[tuple[int, int]], verbatim) -> int:
        """Words in template windows without a conflicting slot, or verbatim. A run counts with its shorter side.

        A slot conflicts if its item value already maps to another value in this passage.
        """
        maps: dict[tuple[int, int], int] = {}
        bad = set()
        for at in sorted({p for a, n in spans for p in range(a, a + n)}):
            kind = int(own.kinds[at - shift])
            if kind != LITERAL and maps.setdefault((kind, int(own.values[at - shift])), int(t.values[at])) != int(t.values[at]):
                bad.add(at)
        words: dict[int, int] = {}
        for p in verbatim:
            words[int(t.of_word[p])] = words.get(int(t.of_word[p]), 0) + 1
        for at in {p for a, n in spans if not any(a <= b < a + n for b in bad) for p in range(a, a + n)}:
            words[at] = max(words.get(at, 0), int(min(np.diff(t.starts[at : at + 2])[0], np.diff(own.starts[at - shift : at - shift + 2])[0])))
        return sum(words.values())


def names_of(hashes: np.ndarray, inside: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Sorted hashes of the forms that are names: capitalised inside sentences, and not more often in lower case."""
    forms, at = np.unique(hashes, return_inverse=True)
    inside, small = (np.bincount(at, weights=x, minlength=len(forms)) for x in (inside, small))
    return forms[(inside > 0) & (inside >= small)]


def name_forms(texts: DataFrame) -> np.ndarray:
    """The same over all texts, added up per block before the shuffle; eight bytes a name are gathered."""

    def count(batches):
        for block in common.blocks_of(batches):
            forms = canonical(block.column(0).combine_chunks(), np.zeros(0, np.uint64)).forms
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in forms], names=["form", "inside", "small"])

    counts = texts.mapInArrow(count, "form long, inside long, small long").groupBy("form").agg(F.sum("inside").alias("inside"), F.sum("small").alias("small"))
    names = counts.where("inside > 0 AND inside >= small").select("form").toArrow()["form"].to_numpy()
    return np.sort(names.astype(np.int64).view(np.uint64))


LEAK = {"item_ids": pa.list_(pa.int64()), "changed_item_ids": pa.list_(pa.int64())}


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """``docs`` with the benchmark items that each row repeats: ``item_ids``, and ``changed_item_ids`` of them
    that it asks with other numbers, names or units. Both sorted; empty for clean, empty and null texts.

    One pass over the documents looks for items of at most ``pass_words`` words; a larger benchmark takes more
    passes. Items are dealt to passes by their identifier. Items without letters and digits or with a null
    item_id are not looked for; items with fewer than five words are found whole and verbatim. Repeated rows get the same answer.
    """
    items = stage(benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))
    words = items.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    passes = int(words // pass_words) + 1
    forms = docs.sparkSession.sparkContext.broadcast(name_forms(docs.select(F.col(text).cast("string").alias("text")).unionAll(items.select("text"))))
    spark = docs.sparkSession
    names = docs.columns
    out = docs
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id", "text").toPandas()
        shared = spark.sparkContext.broadcast((part.item_id.tolist(), part.text.tolist()))
        held: list[Benchmark] = []

        def compute(block: pa.Table, shared=shared, held=held, forms=forms, first=k == 0) -> list[pa.Array]:
            if not held:
                ids, texts = shared.value
                held.append(Benchmark(ids, pa.array(texts, pa.large_string()), names=forms.value))
            bench = held[0]
            leaks = bench.leaks(block.column(names.index(text)).combine_chunks())
            found = [{bench.item_ids[i] for i in row} for row in leaks]
            changed = [{bench.item_ids[i] for i, other in row.items() if other} for row in leaks]
            if not first:
                found = [a | set(b) for a, b in zip(found, block["item_ids"].to_pylist(), strict=True)]
                changed = [a | set(b) for a, b in zip(changed, block["changed_item_ids"].to_pylist(), strict=True)]
            return [pa.array([sorted(x) for x in rows], pa.list_(pa.int64())) for rows in (found, changed)]

        out = common.annotated(out, LEAK, compute)
    return out


def document_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, changed_item_ids of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    leaks = with_leaks(rows, benchmark)
    return leaks.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "changed_item_ids")
