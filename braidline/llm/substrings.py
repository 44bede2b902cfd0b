"""Removal of repeated word windows, found by difference-cover anchors."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, is_empty, release
from .chunks import Kept, in_slices
from .skew import with_groups

WINDOW = 20
#: A perfect difference cover: for any two positions there is one shift below PERIOD that brings both to cover positions.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words of an anchor: after any shift it still lies inside the window that both share.
ANCHOR = WINDOW - PERIOD + 1
#: Hashes known to repeat that a task keeps, at most; more only means that it sends some of them again.
MOST_KNOWN = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WORDS = re.compile(rb"[^ \t-\r]+")


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << n.bit_length()
            self.tables = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in self.bases]
        return [t[:n] for t in self.tables]


_POWERS = [_Powers(b) for b in _BASES]


def _word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


_WORD_HASHES = Kept(_word_hash, 200_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes], starts: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """Hashes of the windows of so many words at the starts: differences of running sums of word hashes times powers."""
    if not len(starts):
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    power, inverse = _POWERS[base].upto(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    return _mixed((sums[starts + length] - sums[starts]) * inverse[starts])


def _anchor_starts(n: int) -> np.ndarray:
    """Cover positions of a document of n words at which an anchor, and a window around it, fit."""
    if n < WINDOW:
        return np.empty(0, np.int64)
    at = np.arange(n - ANCHOR + 1)
    return at[np.isin(at % PERIOD, COVER)]


def row_of(words: list[bytes]) -> int:
    """Tells rows of the same doc_id with different words apart, and orders them: the first 64 bits of the SHA-256 of the words joined by one space."""
    return int.from_bytes(hashlib.sha256(b" ".join(words)).digest()[:8], "big", signed=True)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, digest, row): digest is the SHA-256 of the words joined by one space; row: see row_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            made = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            rows = [int.from_bytes(d[:8], "big", signed=True) for d in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(made, pa.binary()), pa.array(rows, pa.int64())], names=["doc_id", "n_words", "digest", "row"])

    return docs.mapInArrow(run, "doc_id long, n_words long, digest binary, row long")


def _once_a_slice(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that stand for their hash, rows that need not be sent by hash, the repeated hashes) of a slice whose rows are in order.

    A row whose hash came earlier in the slice, or is among those known to repeat, is decided already.
    """
    unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
    decided = np.ones(len(hashes), bool)
    decided[first] = False
    return decided | np.isin(hashes, known), first[n > 1], unique[n > 1]


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at) of the anchors whose hash occurs more than once anywhere. docs: doc_id, text, row.

    A task sends each hash about once, however often it meets it: further ones are decided where they are, and go to
    partitions of their own number. So an anchor in a third of all documents makes a group of one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.uint64)
        for batch in batches:
            all_texts = [(t or "") for t in batch.column(1).to_pylist()]
            for s in in_slices(all_texts):
                hashes, owners, places = [], [], []
                for row, text in enumerate(all_texts[s], s.start):
                    words = text.encode().split()
                    at = _anchor_starts(len(words))
                    if len(at):
                        hashes.append(_hashes(words, at, ANCHOR))
                        owners.append(np.full(len(at), row, np.int64))
                        places.append(at)
                if not hashes:
                    continue
                h, owner, at = map(np.concatenate, (hashes, owners, places))
                decided, first, repeated = _once_a_slice(h, known)
                many = decided.copy()
                many[first] = True
                known = np.union1d(known, repeated)[:MOST_KNOWN]
                key = np.where(decided, _mixed(h + (owner << 32).astype(np.uint64) + at.astype(np.uint64) + np.uint64(1)), h)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(at << 1 | many)], names=["h", "doc_id", "row", "at"])

    rows = docs.mapInArrow(run, "h long, doc_id long, row long, at long")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("h")))
    return rows.where("n > 1 or (at & 1) = 1").select("doc_id", "row", F.shiftright("at", 1).alias("at"))


def _spans(words: list[bytes], anchors: np.ndarray) -> np.ndarray:
    """Starts of all windows that contain one of the anchors at a shift below the period."""
    starts = np.unique((np.asarray(anchors, np.int64)[:, None] - np.arange(PERIOD)[None, :]).ravel())
    return starts[(starts >= 0) & (starts <= len(words) - WINDOW)]


def later_windows(candidates: DataFrame) -> DataFrame:
    """(doc_id, row, at) of the windows around repeated anchors whose words also start a window earlier. candidates: doc_id, text, row, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            rows = batch.column(2).to_pylist()
            anchors = batch.column(3)
            for s in in_slices(texts):
                one, two, owners, places = [], [], [], []
                order = sorted(range(s.start, s.stop), key=lambda i: (ids[i], rows[i]))
                for last, row in zip([None, *order], order, strict=False):
                    if last is not None and (ids[last], rows[last]) == (ids[row], rows[row]):
                        continue  # a repeated row has the same places
                    words = texts[row].encode().split()
                    at = _spans(words, anchors[row].values.to_numpy(zero_copy_only=False))
                    if len(at):
                        one.append(_hashes(words, at, WINDOW, 0))
                        two.append(_hashes(words, at, WINDOW, 1))
                        owners.append(np.full(len(at), row, np.int64))
                        places.append(at)
                if not one:
                    continue
                h1, h2, owner, at = map(np.concatenate, (one, two, owners, places))
                decided, _, _ = _once_a_slice(_mixed(h1) + h2, np.empty(0, np.uint64))
                salt = _mixed((owner << 32).astype(np.uint64) + at.astype(np.uint64) + np.uint64(1))
                h1 = np.where(decided, _mixed(h1 + salt), h1)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(at), pa.array(decided)], names=["h1", "h2", "doc_id", "row", "at", "later"])

    made = candidates.mapInArrow(run, "h1 long, h2 long, doc_id long, row long, at long, later boolean")
    made = made.withColumn("nth", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "row", "at")))
    return made.where("later or nth > 1").select("doc_id", "row", "at")


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return np.cumsum(marks[:-1]) > 0


def without(text: str, covered: np.ndarray) -> str:
    """The text without its covered words; each goes with the white space before it, or, from the start on, with that after it."""
    data, out, at = text.encode(), [], 0
    for m, gone in zip(_WORDS.finditer(data), covered.tolist(), strict=True):
        if not gone:
            out.append(data[at : m.end()] if out or at == 0 or not covered[0] else data[m.start() : m.end()])
        at = m.end()
    return b"".join([*out, data[at:]]).decode()


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(keys, starts, candidates, told): what to remove, and the rows with text in which to look for it.

    keys: doc_id, row, n_words, digest, copy for each row; a copy (same words as a smaller doc_id, or as another row of the
    same) of WINDOW words or more goes whole. starts: doc_id, row, starts, the places of later windows of the other rows.
    told: whether any doc_id has rows of different words; if none has, row is 0, which costs the shuffles nothing.
    """
    release(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keys = cut(digests(own))
    told = not is_empty(keys.groupBy("doc_id").agg((F.min("row") < F.max("row")).alias("many")).where("many"))
    if not told:
        keys = keys.withColumn("row", F.lit(0).cast("long"))
    firsts = cut(keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    keys = cut(with_groups(keys, firsts, "digest", ["doc_id", "digest"], keys.count()).select("doc_id", "row", "n_words", "digest", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")))
    own = with_row(own, told)
    anchors = repeated_anchors(own)
    originals = keys.where(f"not copy and n_words >= {WINDOW}").select("doc_id", "row").distinct()
    anchors = cut(anchors.groupBy("doc_id", "row").agg(F.collect_list("at").alias("anchors")).join(originals, ["doc_id", "row"], "left_semi"))
    candidates = cut(own.join(anchors, ["doc_id", "row"]).select("doc_id", "text", "row", "anchors"))
    return keys, cut(later_windows(candidates).groupBy("doc_id", "row").agg(F.collect_list("at").alias("starts"))), candidates, told


def with_row(own: DataFrame, told: bool) -> DataFrame:
    """Adds row, from the text's words; 0 where doc_ids alone tell rows apart."""

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([row_of((t or "").encode().split()) for t in text], dtype="int64")

    return own.withColumn("row", of("text") if told else F.lit(0).cast("long"))


#: Stands for a null doc_id: such rows come last.
_LAST = (1 << 63) - 1


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A window is WINDOW consecutive words. Each word goes that is covered by a window whose words also start earlier: in
    a smaller doc_id, or in the same document before. All windows are judged on the input. Rows of the same doc_id come
    in an order by their words; of repeated rows one stays. Null texts have no words; rows with null ids come last, as
    one id; other columns are dropped; an empty table gives no rows.

    Anchors of ANCHOR words are hashed at cover positions only. Two windows with the same words have anchors with the
    same words at the same shift, so only windows around repeated anchors can repeat; those are hashed whole (128 bits),
    and the earliest of each hash stays.
    """
    keys, starts, candidates, _ = repeated_windows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.encode().split()
                gone = _covered(len(words), places.values.to_numpy(zero_copy_only=False))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string())))], names=["doc_id", "row", "n_removed", "kept_sha256"])

    edited = candidates.join(starts, ["doc_id", "row"]).select("doc_id", "row", "text", "starts").mapInArrow(run, "doc_id long, row long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "row"])
    repeats = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("n_words"))
    keys = keys.withColumn("copy", F.expr(f"n_words >= {WINDOW}") & (F.col("copy") | (repeats > 1)))
    return keys.join(edited, ["doc_id", "row"], "left").select(
        F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words that substring_dedup() removes cut out of the text; the white space before a cut word goes with it.

    All rows and other columns stay, texts that lose nothing as they are; a copy's text becomes empty. Null texts stay
    null. Columns of any names are carried along, as one struct.
    """
    keys, starts, _, told = repeated_windows(docs, id_col, text_col)
    copies = keys.where(f"copy and n_words >= {WINDOW}").select("doc_id", "row").distinct().withColumn("copy", F.lit(True))
    edits = starts.join(copies, ["doc_id", "row"], "full")
    names = docs.columns
    packed = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at = f"c{names.index(text_col)}"
    rows = docs.select(packed.alias("all"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("doc_id"))
    rows = with_row(rows.withColumn("text", F.col(f"all.{at}").cast("string")), told).join(edits, ["doc_id", "row"], "left")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("text")))

    @F.pandas_udf("string")
    def edited(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, places, copies, nth in parts:
            out = []
            for t, p, c, n in zip(text, places, copies, nth, strict=True):
                if t is None or p is None and not c and n == 1:
                    out.append(t)
                    continue
                words = t.encode().split()
                gone = _covered(len(words), np.asarray(p, np.int64)) if p is not None else np.zeros(len(words), bool)
                if len(words) >= WINDOW and (n > 1 or c):
                    gone[:] = True
                out.append("" if len(gone) and gone.all() else without(t, gone) if gone.any() else t)
            yield pd.Series(out, dtype=object)

    rows = rows.withColumn("edited", edited("text", "starts", F.coalesce("copy", F.lit(False)), "nth"))
    return rows.select(*(F.col("edited").alias(c) if c == text_col else F.col(f"all.c{i}").alias(c) for i, c in enumerate(names)))
