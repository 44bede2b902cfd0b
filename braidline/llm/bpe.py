"""BPE encoding by forced boundaries, and decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CUT, SAFE, SPECIAL, Chunks, Kept, as_symbols, in_slices, once


class ForcedBoundaryBpe:
    """A tokenizer file's BPE model, run on fragments.

    Two neighbouring symbols that stand together inside no vocabulary token can never end up in one token, whatever the
    merges do: each such pair is a certain cut. A word's fragments between cuts are encoded independently, most of them
    from memory, and their ids are concatenated. Normalization and the division into words are the file's own; special
    strings are found first, as the library does.
    """

    #: The division of lower-cased SAFE text into words, as the file's pre-tokenizer has it.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: A fragment inside a word has no end-of-word suffix, the last one has it.
        self.inside = BPE(vocab=model["vocab"], merges=merges)
        self.final = self.tokenizer.model
        bare = (t[: -len(self.end)] if self.end and t.endswith(self.end) else t for t in model["vocab"])
        self.joined = {p for t in bare for p in zip(t, t[1:])}
        self.special = sorted(((t["content"], t["id"]) for t in spec["added_tokens"]), key=lambda x: -len(x[0]))
        self.names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.fragments = Kept(lambda x: [t.id for t in self.inside.tokenize(x)])
        self.words = Kept(self._word)
        self.chunks = Chunks(self._make)

    def cuts(self, word: str) -> list[int]:
        """Where a word in byte symbols is certainly cut."""
        return [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joined]

    def word(self, word: str) -> list[int]:
        """Ids of a word in byte symbols: its fragments between certain cuts, encoded one by one."""
        cuts = self.cuts(word)
        if not cuts:
            return [t.id for t in self.final.tokenize(word)]
        ids = []
        for start, end in zip([0, *cuts], cuts):
            ids += self.fragments[word[start:end]]
        return ids + [t.id for t in self.final.tokenize(word[cuts[-1] :])]

    def _word(self, text: str) -> tuple[bytes, str]:
        ids = self.word(as_symbols(text))
        return array("I", ids).tobytes(), self.decode(ids)

    def plain(self, text: str) -> list[int]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [i for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) for i in self.word(word)]

    def ids(self, text: str) -> list[int]:
        for content, number in self.special:
            left, found, right = text.partition(content)
            if found:
                return [*self.ids(left), number, *self.ids(right)]
        return self.plain(text) if text else []

    def _make(self, chunks: list[str]) -> Iterator[tuple[bytes, str]]:
        word = self.words.__getitem__
        for chunk in chunks:
            if self.lowers and len(chunk) < 200 and SPECIAL not in chunk and SAFE(chunk):
                values = list(map(word, self.WORDS(chunk.lower())))
                yield (values[0] if len(values) == 1 else (b"".join([v[0] for v in values]), " ".join([v[1] for v in values])))
            else:
                ids = self.ids(chunk)
                yield np.array(ids, "<u4").tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: the library puts a space between tokens."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        for values in self.chunks.of(texts):
            yield b"".join(v[0] for v in values), " ".join([v[1] for v in values if v[1]])


def bpe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """Each text's ids by forced-boundary BPE and the text decoded from them: id column, n_tokens and SHA-256 digests of both.

    with_ids adds ids (array<int>), with_decoded adds decoded. Null texts are empty texts: no ids, an empty decoded text.
    Repeated rows give repeated rows, a null id stays null, other columns are dropped, an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(ForcedBoundaryBpe, tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in in_slices(texts):
                made = list(model.encode_decode(texts[s]))
                columns = [batch.column(0)[s], pa.array([len(i) // 4 for i, _ in made], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in made], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in made], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in made], pa.list_(pa.int32())))
                    names.append("ids")
                if with_decoded:
                    columns.append(pa.array([d for _, d in made], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
