"""Texts cut where a tokenizer must cut, so that each distinct chunk is encoded once per worker."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Both vocabularies' pre-tokenizers always start a new word at a space that a non-space follows.
CUT = re.compile(r" (?=\S)")
#: Kept chunks and their characters, at most, before a worker starts its memory anew.
MOST_CHUNKS, MOST_CHARS = 400_000, 12_000_000
#: Characters of text handled at a time.
AT_ONCE = 4_000_000


def in_slices(texts: list[str]) -> Iterator[slice]:
    """Slices of about AT_ONCE characters; a text is never divided."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    yield slice(start, len(texts))


def slices_of(column: pa.Array, at_once: int) -> Iterator[tuple[slice, list[str]]]:
    """Slices of a column of texts of about so many bytes, with their texts, null ones empty; only a slice's are made into Python's at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1
    for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True):
        yield slice(start, stop), [t or "" for t in column.slice(start, stop - start).to_pylist()]


class Chunks:
    """Values by chunk, made for the missing ones at once.

    make: gets chunks (each but a text's first with its leading space), returns a value for each. split divides a
    text, at single spaces. twice: a second memory has what the first one had when it last started anew, and gives back
    what is met again.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], split: Callable[[str], list[str]] = CUT.split, twice: bool = False):
        self.make, self.split, self.twice = make, split, twice
        self.inner: dict = {}
        self.older: dict = {}
        self.chars = 0

    def _fill(self, missing: list[str], prefix: str, into: dict) -> None:
        into.update(zip(missing, self.make([prefix + c for c in missing]), strict=True))

    def of(self, texts: list[str]) -> Iterator[list]:
        """The values of each text's chunks, in order."""
        parts = [self.split(t) for t in texts]
        if len(self.inner) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.older, self.inner, self.chars = self.inner if self.twice else {}, {}, 0
        missing = set().union(*(p[1:] for p in parts)).difference(self.inner)
        self.chars += sum(map(len, missing))
        if known := missing.intersection(self.older):
            self.inner.update((c, self.older[c]) for c in known)
            missing -= known
        self._fill(list(missing), " ", self.inner)
        heads: dict = {}
        self._fill(list({p[0] for p in parts}), "", heads)
        get = self.inner.__getitem__
        for p in parts:
            yield [heads[p[0]], *map(get, p[1:])]


#: Texts of these characters alone (ASCII and Latin-1 letters, with white space) are divided by Python's re as the files' pre-tokenizers divide them; all others go through the library.
SAFE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+").findall
#: How all special strings begin.
SPECIAL = "<|"


def byte_symbols() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


BYTE_SYMBOLS = byte_symbols()


def as_symbols(text: str) -> str:
    """The text's UTF-8 bytes as symbols."""
    return text.encode().decode("latin-1").translate(BYTE_SYMBOLS)


class Kept(dict):
    """A dict that starts anew when it has grown too large; make gives the value of a missing key."""

    MOST = 500_000

    def __init__(self, make: Callable, most: int = MOST):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class ByteIds:
    """A byte-level BPE file's ids, as little-endian bytes of the dtype; special strings as the library's default has them, or with specials=False as plain text.

    SAFE texts, nearly all, are merged by the ranks of the file's own vocabulary (its ids are in the order of the
    merges) with the pre-tokenizer's pattern; the others go through the library, chunk by chunk.
    """

    def __init__(self, path: str, dtype: str = "<u4", specials: bool = True):
        from public_tokenizers import PATTERN
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not specials
        self.specials, self.dtype = specials, np.dtype(dtype)
        byte = {symbol: b for b, symbol in BYTE_SYMBOLS.items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.merged = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = Chunks(self._make)

    def _make(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def of(self, texts: list[str]) -> Iterator[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        for t in texts:
            if not (self.specials and SPECIAL in t) and SAFE(t):
                yield array(code, self.merged(t)).tobytes()
            else:
                (values,) = self.chunks.of([t])
                yield b"".join(values)


_made: dict = {}


def once(kind: type, *args):
    """The worker's own object of this kind, made once and used by all its tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (kind, args) not in _made:
        _made[kind, args] = kind(*args)
    return _made[kind, args]
