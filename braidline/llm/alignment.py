"""Alignment of two tokenizers' tokens over whole texts, and how often their ids end together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release
from .chunks import BYTE_SYMBOLS, ByteIds, once, slices_of

#: Characters of texts that are encoded and aligned at a time; a text is never divided.
_AT_ONCE = 1_000_000
#: Intervals that are looked through one by one rather than together.
_FEW = 32


def common_ends(a: np.ndarray, b: np.ndarray, i: np.ndarray, i_end: np.ndarray, j: np.ndarray, j_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in a, in b) of all ends that two ascending lists share, in order, within intervals i to i_end of a and j to j_end of b whose last ends are equal.

    Divide and conquer, a level of all intervals at a time: an end of a near the middle of an interval is sought in b by
    bisection, then those further from the middle, until one is common; there the interval is cut, and both halves go on
    by themselves. An interval without a common end inside is a leaf.
    """
    partner = np.full(len(a), -1)
    partner[i_end] = j_end
    while True:
        inner = np.flatnonzero((i < i_end) & (j < j_end))
        if not len(inner):
            break
        i, i_end, j, j_end = i[inner], i_end[inner], j[inner], j_end[inner]
        middle = (i + i_end) // 2
        at = np.searchsorted(b, a[middle])
        k = np.where(b[at] == a[middle], middle, -1)
        left, step = np.flatnonzero(k < 0), 0
        while len(left) > _FEW:
            step += 1
            for near in (middle[left] - step, middle[left] + step):
                inside = (k[left] < 0) & (near >= i[left]) & (near < i_end[left])
                one, near = left[inside], near[inside]
                at_near = np.searchsorted(b, a[near])
                common = b[at_near] == a[near]
                k[one[common]], at[one[common]] = near[common], at_near[common]
            left = left[(k[left] < 0) & ((middle[left] - step > i[left]) | (middle[left] + step + 1 < i_end[left]))]
        for x in left.tolist():
            k[x], at[x] = _nearest(a, b, int(i[x]), int(middle[x]), int(i_end[x]), step)
        cut_ = np.flatnonzero(k >= 0)
        k, at, i, i_end, j, j_end = (x[cut_] for x in (k, at, i, i_end, j, j_end))
        partner[k] = at
        i, i_end, j, j_end = np.concatenate([i, k + 1]), np.concatenate([k, i_end]), np.concatenate([j, at + 1]), np.concatenate([at, j_end])
    found = np.flatnonzero(partner >= 0)
    return found, partner[found]


def _nearest(a: np.ndarray, b: np.ndarray, first: int, middle: int, end: int, step: int) -> tuple[int, int]:
    """The common end more than step from the middle that is nearest to it, by blocks outwards; -1 where there is none."""
    size = 16
    while middle - step > first or middle + step + 1 < end:
        low, high = np.arange(max(first, middle - step - size), middle - step)[::-1], np.arange(middle + step + 1, min(end, middle + step + 1 + size))
        near = np.concatenate([low, high])
        at = np.searchsorted(b, a[near])
        common = np.flatnonzero(b[at] == a[near])
        if len(common):
            best = common[np.argmin(np.abs(near[common] - middle))]
            return int(near[best]), int(at[best])
        step, size = step + size, 2 * size
    return -1, -1


class _Digits:
    """Decimal forms of ids, as a table of digits."""

    def __init__(self, most: int):
        shown = np.array([str(i) for i in range(most)], "S")
        self.sizes = np.char.str_len(shown)
        self.digits = shown.view(np.uint8).reshape(most, -1)

    def joined(self, ids: np.ndarray, after: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All ids, each with the character after it, and where each ends with that."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = after
        first = ends - 1 - sizes
        for d in range(self.digits.shape[1]):
            has = np.flatnonzero(sizes > d)
            out[first[has] + d] = self.digits[ids[has], d]
        return out.tobytes(), ends


class Aligner:
    """Groups of tokens of a byte-level BPE file (A) and a sentencepiece model (B) over space + text, many texts at a time."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteIds(a_path, specials=False)
        byte = {symbol: b for b, symbol in BYTE_SYMBOLS.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 2)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in t)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.digits = _Digits(max(len(self.a_bytes), len(self.b_bytes)))

    def of(self, texts: list[str]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """(tokens of A, tokens of B, groups, groups as text, linked pairs as 64-bit numbers) of each text."""
        spaced = [" " + t if t else "" for t in texts]
        a = [np.frombuffer(x, "<u4") for x in self.a.of(spaced)]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]  # adds the space itself
        good = []
        for i, t in enumerate(spaced):
            whole = t.encode()
            # the library's ids may end with added tokens, which have no bytes of their own
            if whole and (not len(a[i]) or a[i].max() < len(self.a_bytes)) and b"".join([self.a_bytes[x] for x in a[i].tolist()]) == whole == b"".join([self.b_bytes[x] for x in b[i].tolist()]):
                good.append(i)
        results = dict(zip(good, self._aligned([a[i] for i in good], [b[i] for i in good]), strict=True)) if good else {}
        for i in range(len(texts)):
            yield results.get(i, (0, 0, 0, b"", b""))

    def _aligned(self, a_lists: list[np.ndarray], b_lists: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """The same for texts that both tokenizers give back, by their ids; all are one long text, cut at the texts' ends first."""
        n_a, n_b = (np.array([*map(len, x)], np.int64) for x in (a_lists, b_lists))
        a, b = np.concatenate(a_lists).astype(np.int64), np.concatenate(b_lists)
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        i, j = common_ends(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), last_a - n_a, last_a - 1, last_b - n_b, last_b - 1)
        # a group's tokens of A come after the tokens of B of the groups before, and those of B after the group's of A
        of_a, of_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(j + 1 - of_b, of_a)
        place_b = np.arange(len(b)) + np.repeat(i + 1, of_b)
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        after[place_a[i]], after[place_b[j]] = ord("|"), ord(";")
        shown, ends = self.digits.joined(ids, after)
        links = a[i] << 32 | b[j]
        groups = np.searchsorted(i, last_a)
        stops = ends[last_a + last_b - 1]
        start = link = 0
        for x, y, group, stop in zip(n_a.tolist(), n_b.tolist(), groups.tolist(), stops.tolist(), strict=True):
            yield x, y, group - link, shown[start : stop - 1], links[link:group].tobytes()
            start, link = stop, group


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """id column, n_a, n_b, n_groups, groups_sha256, linked of every row, and with with_groups groups (`a1,a2|b1;a3|b2,b3`).

    linked: the pairs of tokens that end together, 64-bit little-endian numbers of A's id in the upper and B's in the
    lower half. Null and empty texts, and those that either tokenizer does not give back byte by byte, have no tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once(Aligner, a_path, b_path)
        for batch in batches:
            for s, texts in slices_of(batch.column(1), _AT_ONCE):
                n, shown, digests, linked = [], [], [], []
                for a, b, groups, text, pairs in aligner.of(texts):
                    n.append((a, b, groups))
                    digests.append(hashlib.sha256(text).hexdigest() if text else "")
                    linked.append(pairs)
                    if with_groups:
                        shown.append(text.decode())
                longs = [pa.array([x[k] for x in n], pa.int64()) for k in range(3)]
                columns = [batch.column(0)[s], *longs, pa.array(digests, pa.string()), pa.array(linked, pa.binary()), *[pa.array(shown, pa.string())] * with_groups]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_a", "n_b", "n_groups", "groups_sha256", "linked", *["groups"] * with_groups])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, linked binary" + ", groups string" * with_groups)


def link_counts(made: DataFrame) -> DataFrame:
    """(a, b, n): how many links of all rows of alignments() hold a pair of ids.

    Tokens that end together are each other's endings, so there are no more pairs than the bytes of both vocabularies'
    tokens (a token has as many endings as bytes, each of them one id of the other side, or two where a byte has a token
    of its own besides): some hundred thousand, however many texts there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            values = batch.column(0)
            found, count = np.unique(np.frombuffer(b"".join(x for x in values.to_pylist() if x), "<i8"), return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, count]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

    return made.select("linked").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class _Counts:
    """The counts of all pairs, in the order of the pairs, and which of them are their B id's highest."""

    def __init__(self, rows: list):
        pairs = np.array([r.a << 32 | r.b for r in rows], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.n = pairs[order], np.array([r.n for r in rows], np.int64)[order]
        b = self.pairs & 0xFFFFFFFF
        highest = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
        np.maximum.at(highest, b, self.n)
        self.best = (self.n == highest[b]).astype(np.int64)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """id column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, and with with_groups groups.

    A group is what both tokenizers' tokens lie between two byte offsets at which tokens of both end, with none between;
    a link is the two tokens that end there. count_sum adds up over a row's links how many links of all rows hold the
    same two ids; n_best counts those links whose pair no pair with the same B id exceeds. Texts are encoded and aligned
    once, and written; the counts of pairs, which the vocabularies bound (see link_counts()), are broadcast. Null and
    empty texts, and those that either tokenizer does not give back, have zeros and an empty groups_sha256. Repeated
    rows give repeated rows, a null id stays null, other columns are dropped, an empty table gives no rows.
    """
    spark = docs.sparkSession
    release(spark)
    made = cut(alignments(docs, a_path, b_path, id_col, text_col, with_groups))
    counts = spark.sparkContext.broadcast(_Counts(link_counts(made).collect()))
    kind = made.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts.value
        for batch in batches:
            linked = [x or b"" for x in batch.column("linked").to_pylist()]
            n = np.array([len(x) // 8 for x in linked], np.int64)
            at = np.searchsorted(own.pairs, np.frombuffer(b"".join(linked), "<i8"))
            ends = np.cumsum(n)
            sums = [np.concatenate([np.zeros(1, np.int64), np.cumsum(x[at])]) for x in (own.best, own.n)] if len(at) else [np.zeros(1, np.int64)] * 2
            columns = {c: batch.column(c) for c in batch.schema.names if c != "linked"}
            columns |= {"n_links": pa.array(n)} | {c: pa.array(x[ends] - x[ends - n]) for c, x in zip(("n_best", "count_sum"), sums, strict=True)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    return made.mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups)
