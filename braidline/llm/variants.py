"""Spelling variants of a corpus's words: those one edit apart, found by a bit-sliced index of letters by position."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, is_empty, release
from .chunks import in_slices

LEAST_LENGTH, LEAST_COUNT, TIMES, PERIOD = 6, 5, 5, 199
#: Words of a group that are indexed together; larger groups are divided while they can be.
MOST_WORDS = 256
#: Distinct words that a task counts before it sends what it has.
MOST_COUNTED = 400_000
#: Words of a bitset, and cells of a bit-sliced index that are made at a time.
BITS, MOST_CELLS = 64, 2_000_000
#: In Latin-1: letters, A-Z lower-cased; all else, and every character beyond it, a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: What a zero byte makes of the last byte of a CRC-32 register.
_ZERO_BYTE = np.array([zlib.crc32(b"\0", i ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
#: Bytes of a word up to which checksums are combined in a table.
_TABLE = 64


class _Words(dict):
    """Numbers of words (Latin-1), with the lengths and CRC-32 of their UTF-8."""

    def __init__(self):
        super().__init__()
        self.sizes: list[int] = []
        self.crcs: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.sizes)
        utf8 = utf8_of(word)
        self.sizes.append(len(utf8))
        self.crcs.append(zlib.crc32(utf8))
        return n


def utf8_of(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def _checksums(prefixes: list[bytes], docs: np.ndarray, numbers: np.ndarray, words: _Words) -> np.ndarray:
    """CRC-32 of each word after its document's prefix: as the checksum is linear, the prefix's, moved on by the word's length, and the word's own."""
    moved = np.empty((_TABLE, len(prefixes)), np.uint32)
    moved[0] = [zlib.crc32(p) for p in prefixes]
    for k in range(1, _TABLE):
        moved[k] = (moved[k - 1] >> 8) ^ _ZERO_BYTE[moved[k - 1] & 255]
    sizes = np.array(words.sizes, np.int64)[numbers]
    h = moved[np.minimum(sizes, _TABLE - 1), docs] ^ np.array(words.crcs, np.uint32)[numbers]
    long = np.flatnonzero(sizes >= _TABLE)
    if len(long):
        spelled = list(words)
        h[long] = [zlib.crc32(utf8_of(spelled[numbers[i]]), zlib.crc32(prefixes[docs[i]])) for i in long.tolist()]
    return h


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, period: int = PERIOD) -> DataFrame:
    """(word, n): how often each run of letters `[A-Za-zÀ-ÿ]+` occurs, lower-cased in A-Z.

    Of an occurrence whose h, the CRC-32 of `<id>:<run>`, the period divides, the code point number h modulo the length
    is deleted first. Words of fewer code points than least_length are left out. A null id counts as an empty one; null
    texts have no words. A task sends each word with its count, not its occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in counts.items() if len(w) >= least_length]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            prefixes = [f"{i or ''}:".encode() for i in batch.column(0).to_pylist()]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in in_slices(texts):
                words, parts = _Words(), []
                for text in texts[s]:
                    found = text.encode("latin-1", "replace").translate(_FOLD).split()
                    parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                numbers, docs_of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                h = _checksums(prefixes[s], docs_of, numbers, words)
                edited = h % np.uint32(period) == 0
                spelled = list(words)
                for w, n in zip(spelled, np.bincount(numbers[~edited], minlength=len(spelled)).tolist(), strict=True):
                    if n and len(w) >= least_length:
                        counts[w] += n
                for i, x in zip(numbers[edited].tolist(), h[edited].tolist(), strict=True):
                    at = x % len(spelled[i])
                    counts[spelled[i][:at] + spelled[i][at + 1 :]] += 1
                if len(counts) > MOST_COUNTED:
                    yield sent()
        yield sent()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class BitSliced:
    """Words of many small groups as bits: for each set of 64 words, each position and letter, which words have it there."""

    def __init__(self, words: list[bytes], sets: np.ndarray, bits: np.ndarray, n_sets: int):
        sizes = np.array([len(w) for w in words], np.int64)
        letters, codes = np.unique(np.frombuffer(b"".join(words), np.uint8), return_inverse=True)
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.codes, self.firsts = codes, np.cumsum(sizes) - sizes
        #: One position more than the longest word has: nothing is there.
        self.at = np.zeros((int(sizes.max(initial=0)) + 1, n_sets, max(1, len(letters))), np.uint64)
        np.bitwise_or.at(self.at, (place, sets[owner], codes), np.uint64(1) << bits[owner].astype(np.uint64))

    def within_one_edit(self, queries: np.ndarray, sets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(same so far, one letter replaced, one letter more) after all letters of each query, words of that size, as bits over its set's words.

        Word-parallel recurrences: a query's letter keeps the words that have it at its position, or, once a word has
        had a letter more, at the next one. The last of the three has no letter more after the query's end.
        """
        same = np.full(len(queries), ~np.uint64(0))
        replaced, longer = np.zeros(len(queries), np.uint64), np.zeros(len(queries), np.uint64)
        for i in range(size):
            letter = self.codes[self.firsts[queries] + i]
            here, next_ = self.at[i, sets, letter], self.at[i + 1, sets, letter]
            replaced = (replaced & here) | same
            longer = (longer | same) & next_
            same &= here
        return same, replaced, longer


def _near_in(groups: list[tuple[int, bool, list[bytes], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, longer) of the words one edit apart. groups: (size, at the end, middles, number of the first word), all of one size.

    Each pair is found in one group only: a longer word that has the whole query before its further letter belongs to the
    group of a later segment, unless there is none.
    """
    size = groups[0][0]
    words = [w for g in groups for w in g[2]]
    n = np.array([len(g[2]) for g in groups], np.int64)
    group = np.repeat(np.arange(len(groups)), n)
    rank = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    per = -(-n // BITS)
    base = np.cumsum(per) - per
    sets, bits = base[group] + rank // BITS, rank % BITS
    index = BitSliced(words, sets, bits, int(per.sum()))
    short = np.array([len(w) == size for w in words])
    of_size = lambda keep: np.bitwise_or.reduceat(np.where(keep, np.uint64(1) << bits.astype(np.uint64), np.uint64(0)), np.flatnonzero(bits == 0))
    shorts, longs = of_size(short), of_size(~short)
    members = np.flatnonzero(bits == 0)  # the first word of each set

    own = np.flatnonzero(short)
    times = per[group[own]]
    queries = np.repeat(own, times)
    sets_of = base[group[queries]] + np.arange(len(queries)) - np.repeat(np.cumsum(times) - times, times)
    same, replaced, longer = index.within_one_edit(queries, sets_of, size)
    at_end = np.array([g[1] for g in groups])[group[queries]]
    longer = np.where(at_end, longer | same, longer & ~same) & longs[sets_of]
    replaced &= shorts[sets_of] & ~same
    numbers = np.concatenate([np.arange(len(g[2])) + g[3] for g in groups])
    out = []
    for found, kind in ((replaced, False), (longer, True)):
        hit = np.flatnonzero(found)
        row, bit = np.nonzero(np.unpackbits(found[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        out.append((numbers[queries[hit[row]]], numbers[members[sets_of[hit[row]]] + bit], np.full(len(row), kind)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segments(m: Column, lo: Column, hi: Column) -> Column:
    """Both halves of a segment."""
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(m.alias("m"), lo.alias("lo"), middle.alias("hi")), F.struct(m.alias("m"), middle.alias("lo"), hi.alias("hi")))


_KEY = ["m", "lo", "hi", "prefix", "suffix"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of the row's segment [lo, hi) in its class m: what stands before and after the segment."""
    tail, size = F.col("m") - F.col("hi"), F.length("word")
    return rows.withColumns({"prefix": F.substr("word", F.lit(1), F.col("lo")), "suffix": F.substr("word", size - tail + 1, tail)})


def _grouped(vocabulary: DataFrame, most: int) -> DataFrame:
    """(m, lo, hi, prefix, suffix, words): groups of words one of which can be one edit from others within the segment, each pair in a group.

    In class m, words of m letters meet those of m and of m + 1. They are one edit apart in one of two segments of the m
    letters, and equal before and after it. A group of more words than most is divided by halves of its segment, round
    by round, down to one letter, where no more words can be left than alphabets allow.
    """
    size, zero = F.length("word"), F.lit(0)
    classes = F.flatten(F.array(_segments(size, zero, size), F.when(size > 1, _segments(size - 1, zero, size - 1)).otherwise(F.array().cast("array<struct<m:int,lo:int,hi:int>>"))))
    rows = cut(_keyed(vocabulary.select("word", F.explode(classes).alias("x")).select("word", "x.*").where("lo < hi or m = 1")))
    ready = None
    while True:
        large = cut(rows.where("hi - lo > 1").groupBy(*_KEY).agg(F.count("*").alias("n"), F.count_if(F.length("word") == F.col("m")).alias("short")).where((F.col("n") > most) & (F.col("short") > 0)).select(*_KEY))
        last = is_empty(large)
        small = rows if last else rows.join(large, _KEY, "left_anti").select(*rows.columns)
        ready = small if ready is None else ready.unionByName(small)
        if last:
            break
        halves = rows.join(large, _KEY, "left_semi").select("word", F.explode(_segments(F.col("m"), F.col("lo"), F.col("hi"))).alias("x")).select("word", "x.*")
        rows = cut(_keyed(halves))
    groups = ready.groupBy(*_KEY).agg(F.collect_list("word").alias("words"), F.count_if(F.length("word") == F.col("m")).alias("short"))
    return groups.where("short > 0 and size(words) > 1").drop("short")


def near_words(vocabulary: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, near): all pairs of distinct words of vocabulary (word) that differ by exactly one inserted, deleted or replaced code point, both ways round. Words are of Latin-1 letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
            spelled = [w.encode("latin-1") for w in flat.to_pylist()]
            m, lo, hi = (batch.column(c).to_pylist() for c in ("m", "lo", "hi"))
            by: dict[int, list] = {}
            at = 0
            for k, n in enumerate(np.diff(lists.offsets.to_numpy()).tolist()):
                tail = m[k] - hi[k]
                by.setdefault(hi[k] - lo[k], []).append((hi[k] - lo[k], hi[k] == m[k], [w[lo[k] : len(w) - tail] for w in spelled[at : at + n]], at))
                at += n
            for size, groups in by.items():
                cells = np.cumsum([(-(-len(g[2]) // BITS)) * (size + 2) * 64 for g in groups])
                for some in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(cells // MOST_CELLS)) + 1):
                    query, other, longer = _near_in([groups[i] for i in some])
                    # of words of one length each finds the other; of others only the shorter one does
                    one, two = np.concatenate([query, other[longer]]), np.concatenate([other, query[longer]])
                    yield pa.RecordBatch.from_arrays([flat.take(pa.array(one)), flat.take(pa.array(two))], names=["word", "near"])

    return _grouped(vocabulary.select("word"), most).select("m", "lo", "hi", "words").mapInArrow(run, "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that follows from each, by doubling the steps in each round; forms never lead back."""
    rows = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        rows = cut(rows.join(further, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if is_empty(rows.where("moved")):
            return rows.select("word", "root")
        rows = rows.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, period: int = PERIOD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of word_counts() with at least least_count occurrences.

    n_near is the number of such words that are exactly one edit away; form is the one of them with the largest n (of
    equals the smallest in code-point order) if that is at least times the word's own, else null, with its n; root is the
    last form that follows from the word, or the word itself. Repeated rows count each; null texts and an empty table
    give no words; other columns are dropped.
    """
    release(docs.sparkSession)
    words = cut(word_counts(docs, id_col, text_col, least_length, period).where(F.col("n") >= least_count))
    near = near_words(words).join(words.withColumnsRenamed({"word": "near", "n": "near_n"}), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    rows = cut(words.join(best, "word", "left").withColumn("has", (-F.col("best.n")) >= times * F.col("n")).select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), -F.col("best.n")).alias("form_n")))
    rows = rows.join(roots(rows.where("form is not null")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
