"""Exact token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator, Sequence
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .chunks import BYTE_PIECES, BYTE_SYMBOLS, SAFE, SPECIAL, Chunks, Kept, in_slices, once

LIMIT = 1024
#: A single space between non-spaces: also every prefix is cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space but the space and the line feed.
_OTHER_SPACE = re.compile(r"[^\S \n]").search
#: A SAFE word without an apostrophe, or a sign with which special strings begin.
_PLAIN = re.compile(r" ?[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch
#: Entries of each kept table, at most.
_KEPT = 300_000
#: Stands for no token.
_NONE = 0xFFFFFFFF
#: By base: a table that adds it to small counts, for bytes.translate().
_MORE = [bytes((base + c) % 256 for c in range(256)) for base in range(96)]
#: For bytes.translate(): 1 for a byte that begins a character in UTF-8, else 0.
_BEGINS = bytes(b & 0xC0 != 0x80 for b in range(256))
_RUNS = re.compile(r"\s+")
#: Contractions that are pieces of their own, but whose first two characters are not.
_CONTRACTIONS = {"'re", "'ve", "'ll"}


def _divided(text: str) -> list[str]:
    """The text divided at _CUT: of most texts at all spaces."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE(text):
        return _CUT.split(text)
    return text.split(" ")


def _packed(counts: Sequence[int]) -> Sequence[int]:
    """Small counts as bytes, which take little memory and are joined at once."""
    try:
        return bytes(counts)
    except ValueError:
        return tuple(counts)


class PrefixCounts:
    """Token counts of every prefix under a byte-level BPE file.

    Over a piece (the pre-tokenizer's unit) the table runs from left to right, token by token of its encoding. At a
    token's end the count is that of the tokens so far. Inside a token it is theirs plus that of the token's own
    beginning, if that beginning's first token stays apart from the token before; such tables are kept by pairs of
    tokens. Where it does not, the encoding of the prefix ends in the one token t for which the encoding of the rest
    ends in a token that stays apart from t, and the count is the rest's count plus one. Whether two tokens stay apart is
    decided once for each pair, by the merge ranks (ids are in the order of the merges). Counts are also kept by piece,
    the steps between them by chunk, and a text's counts are the running sums of its chunks' steps.
    Where a prefix divides otherwise than the whole text (white space before a word, contractions, special strings), the
    count is that of the prefix's own division.
    """

    def __init__(self, path: str):
        from public_tokenizers import PATTERN
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        byte = {symbol: b for b, symbol in BYTE_SYMBOLS.items()}
        self.ids = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.merged, tokens = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})._core_bpe.encode_single_piece, self.tokens
        #: By both ids, in one number.
        self.apart = Kept(lambda pair: self.merged(tokens[pair >> 32] + tokens[pair & 0xFFFFFFFF]) == [pair >> 32, pair & 0xFFFFFFFF])
        #: The encodings of tokens' own beginnings, and the tables of tokens after others.
        self.starts = Kept(self.merged, _KEPT)
        self.within = Kept(self._within, _KEPT)
        self.pieces = Kept(self._piece, _KEPT)
        self.chunks = Chunks(self._make, _divided, twice=True)

    def _within(self, pair: int) -> tuple[bytes, tuple[int, ...], tuple[int, ...]]:
        """(counts, undecided places, last tokens) of the prefixes of a token's bytes, the whole included, after another token (_NONE: after nothing).

        A prefix's own encoding stands after the other token as it is if its first token stays apart from that one; else
        the prefix is undecided.
        """
        before, token = pair >> 32, pair & 0xFFFFFFFF
        s = self.tokens[token]
        encoded = [self.starts[s[:i]] for i in range(1, len(s))]
        undecided = () if before == _NONE else tuple(i for i, ids in enumerate(encoded) if not self.apart[before << 32 | ids[0]])
        return bytes([*map(len, encoded), 1]), undecided, (*(ids[-1] for ids in encoded), token)

    def _piece(self, piece: str) -> Sequence[int]:
        """Counts after each of the piece's characters."""
        s = piece.encode()
        tokens = self.merged(s)
        within, before = self.within, _NONE
        parts, undecided, last = [], [], []
        for more, t in zip(chain(_MORE, repeat(None)), tokens):
            counts, places, lasts = within[before << 32 | t]
            if places:
                at = len(last)
                undecided += [at + i for i in places]
            last += lasts
            parts.append(counts.translate(more) if more else [len(parts) + c for c in counts])
            before = t
        out = b"".join(parts) if len(tokens) <= len(_MORE) else [*chain.from_iterable(parts)]
        if undecided:
            out = self._decided(s, [*out], last, undecided)
        return _packed(out if len(s) == len(piece) else [*compress(out, s[1:].translate(_BEGINS) + b"\1")])

    def _decided(self, s: bytes, counts: list[int], last: list[int], undecided: list[int]) -> list[int]:
        """The counts with those of undecided prefixes of s put in, from left to right; last: the last tokens of the others."""
        ids, apart, tokens = self.ids, self.apart, self.tokens
        for i in undecided:
            # most often the last token has grown by a byte, or begins with this byte or one shortly before
            grown = i - len(tokens[last[i - 1]])
            start, step = grown, i
            while (t := ids.get(s[start : i + 1])) is None or start and not apart[last[start - 1] << 32 | t]:
                if step == grown:
                    step -= 1
                if step < 0:
                    raise ValueError(f"the vocabulary cannot write {s!r}")
                start, step = step, step - 1
            counts[i], last[i] = (counts[start - 1] if start else 0) + 1, t
        return counts

    def _encode(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _segment(self, text: str) -> list[int]:
        """Counts of a text without special strings."""
        if SAFE(text):
            found = BYTE_PIECES(text)
        else:
            found = [text[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        out: list[int] = []
        base = 0
        for piece in found:
            counts = self.pieces[piece]
            out += [base + c for c in counts] if base else counts
            if piece in _CONTRACTIONS:
                out[-2] = base + 2
            base += counts[-1]
        for run in _RUNS.finditer(text):
            # at the end of a prefix, a run of white space is one piece
            before = out[run.start() - 1] if run.start() else 0
            out[run.start() : run.end()] = [before + c for c in self._space(run.group())]
        return out

    def _space(self, run: str) -> list[int]:
        out: list[int] = []
        for piece in ([run] if SAFE(run) else [run[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(run)]):
            out += [(out[-1] if out else 0) + c for c in self.pieces[piece]]
        return out

    def of_chunk(self, text: str) -> Sequence[int]:
        if _PLAIN(text):
            if (text[1:] if text[0] == " " else text).isalpha():
                return self._piece(text)  # kept as a chunk
            out: list[int] = []
            for piece in BYTE_PIECES(text):
                base = out[-1] if out else 0
                out += [base + c for c in self.pieces[piece]]
            return _packed(out)
        out, base, at = [], 0, 0
        while at < len(text):
            found = min(((i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0), default=None)
            end = found[0] if found else len(text)
            if end > at:
                out += [base + c for c in self._segment(text[at:end])]
            if found:
                stop = end + len(found[2])
                out += [base + self._encode(text[at:j]) for j in range(end + 1, stop)]
                base = base + (self._encode(text[at:end]) if end > at else 0) + 1
                out.append(base)
                at = stop
            else:
                at = end
        return _packed(out)

    def _make(self, chunks: list[str]) -> list[Sequence[int]]:
        # a word of ASCII letters is a piece, and kept as a chunk
        counts = [self._piece(c) if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else self.of_chunk(c) if c else b"" for c in chunks]
        for i, chunk in enumerate(chunks):
            if chunk[-1:].isspace():
                counts[i] = _packed([*counts[i][:-1], self._encode(chunk)])
        return steps_of(counts)

    def totals_and_counts(self, texts: list[str]) -> Iterator[tuple[int, list[Sequence[int]]]]:
        """Of each text the count of the whole, and its chunks' steps; see whole()."""
        for values in self.chunks.of(texts):
            yield int(whole(values)[-1]), values


def steps_of(counts: list[Sequence[int]]) -> list[Sequence[int]]:
    """The steps between the counts of each chunk, from 0 on: as signed bytes, or a tuple where that is too little."""
    joined = np.frombuffer(b"".join(c if type(c) is bytes else b"" for c in counts), np.uint8)
    ends = np.cumsum(np.fromiter((len(c) if type(c) is bytes else 0 for c in counts), np.int64, len(counts)))
    steps = joined.copy()
    steps[1:] -= joined[:-1]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = starts[starts < ends]
    steps[first] = joined[first]
    data, at = steps.tobytes(), ends.tolist()
    out: list[Sequence[int]] = [data[i:j] for i, j in zip([0, *at], at, strict=False)]
    large = np.searchsorted(ends, np.flatnonzero(joined > 127), "right")  # counts whose steps may not be bytes
    for i in {*large.tolist(), *(i for i, c in enumerate(counts) if type(c) is not bytes)}:
        wide = np.diff(np.array([0, *counts[i]], np.int64))
        out[i] = wide.astype(np.int8).tobytes() if -128 <= wide.min() and wide.max() <= 127 else tuple(wide.tolist())
    return out


def whole(values: list[Sequence[int]]) -> np.ndarray:
    """The counts of every prefix of a text, the empty one first, from its chunks' steps."""
    return from_steps(as_steps(values))


def as_steps(values: list[Sequence[int]]) -> bytes:
    """The steps of a text from its chunks', each one byte, or four where that is too little; the first byte tells which."""
    try:
        return b"\1" + b"".join(values)
    except TypeError:  # some are not bytes
        return b"\4" + np.concatenate([np.frombuffer(v, np.int8) if type(v) is bytes else np.array(v) for v in values]).astype("<i4").tobytes()


def from_steps(steps: bytes) -> np.ndarray:
    """The counts of every prefix, the empty one first."""
    return np.concatenate([np.zeros(1, np.int64), np.frombuffer(steps, "<i4" if steps[0] == 4 else np.int8, offset=1).cumsum(dtype=np.int64)])


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, n_bytes and prefix_steps of every row: the exact token count at each prefix of the text, by characters, as as_steps() has it.

    Null texts are empty. Repeated rows give repeated rows, a null id stays null, other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(PrefixCounts, tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in in_slices(texts):
                gc.disable()  # the kept values have no cycles, and there are too many to go through within a slice
                try:
                    steps = [as_steps(values) for values in counter.chunks.of(texts[s])]
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], pa.array([len(t.encode()) for t in texts[s]], pa.int64()), pa.array(steps, pa.binary())], names=[id_col, "n_bytes", "prefix_steps"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, prefix_steps binary")


def truncated(counted: DataFrame, limit: int, steps_col: str = "prefix_steps", out_col: str = "fit_chars") -> DataFrame:
    """Adds the characters of the longest prefix of at most limit tokens, from the stored counts alone."""

    @F.pandas_udf("long")
    def fit(steps: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(from_steps(x) <= limit)[-1] for x in steps], dtype="int64")

    return counted.withColumn(out_col, fit(steps_col))


def tokens_at(counted: DataFrame, chars: int, steps_col: str = "prefix_steps", out_col: str = "tokens_at") -> DataFrame:
    """Adds the token count of the first chars characters (of the whole text where it is shorter), from the stored counts alone."""

    @F.pandas_udf("long")
    def at(steps: pd.Series) -> pd.Series:
        return pd.Series([c[min(chars, len(c) - 1)] for c in map(from_steps, steps)], dtype="int64")

    return counted.withColumn(out_col, at(steps_col))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_prefixes: bool = False) -> DataFrame:
    """id column, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_chars (characters of the longest prefix of at most limit tokens).

    prefix_counts() are written to the shared folder, and all answers come from there. with_prefixes adds prefix_steps,
    with which truncated() and tokens_at() answer later questions without encoding again. Null texts are empty: 0
    bytes, 0 tokens. Repeated rows give repeated rows, a null id stays null, other columns are dropped; an empty table
    gives no rows. A text of any length is counted whole.
    """
    stored = cut(prefix_counts(docs, tokenizer, id_col, text_col))
    counted = truncated(tokens_at(stored, 1 << 62, out_col="n_tokens"), limit).withColumn("over_limit", F.col("n_tokens") > limit)
    return counted.select(id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars", *["prefix_steps"] * with_prefixes)
