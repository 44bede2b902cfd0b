"""Packing by concatenate-and-cut: partition totals give global offsets, fixed windows cut the stream of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .chunks import ByteIds, in_slices, once

SEQUENCE_TOKENS = 1024
END_ID = 0

_TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
_PIECES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("sequence_length", T.IntegerType()))])


def id_type(tokenizer: str) -> str:
    """Two bytes an id where the vocabulary fits."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """A row per document: its partition, its first token's place in the partition, its tokens with the end id (uint16 where ids fit, else uint32)."""

    dtype = id_type(tokenizer)
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encoder = once(ByteIds, tokenizer, dtype)
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            texts, keys = [t or "" for t in batch.column(1).to_pylist()], batch.column(0)
            for s in in_slices(texts):
                ids = [x + end for x in encoder.of(texts[s])]
                n = np.array([len(x) // width for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([keys[s], pa.array(np.full(len(n), part, np.int32)), pa.array(starts, pa.int64()), pa.array(n), pa.array(ids, pa.binary())], names=_TOKENS.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All documents' tokens in one stream, cut into sequences of sequence_tokens; a row per piece of a document in a sequence.

    Pass one tokenizes each document once and writes the ids to the shared folder, with running totals inside each
    partition. The totals, one number a partition, are summed up on the driver to each partition's offset in the whole
    stream. Pass two knows each token's global place: it cuts every document at the multiples of sequence_tokens, and a
    document that crosses one leaves boundary pieces in both sequences. Only the last sequence can be short; it is padded
    to sequence_tokens, unless its length is a power of two, at which it is left (sequence_length).

    Null and empty texts are their end id alone; repeated rows and ids are packed as rows of their own; a null id stays
    null; other columns are dropped; an empty table gives no pieces. with_ids adds the piece's ids (token_ids).
    """
    made = cut(tokens(docs, tokenizer, id_col, text_col, end_id))
    dtype = id_type(tokenizer)
    offsets, total = {}, 0
    for part, n in sorted(made.groupBy("part").agg(F.sum("n")).collect()):  # a row for each input partition
        offsets[part], total = total, total + n
    last = total % sequence_tokens
    last_length = sequence_tokens if last == 0 or last & (last - 1) else last
    schema = T.StructType([*_PIECES.fields, *([T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = batch.column(0), batch.column(3).to_numpy()
            if not len(n):
                continue
            begin = np.array([offsets[p] for p in batch.column(1).to_pylist()], np.int64) + batch.column(2).to_numpy()
            first, final = begin // sequence_tokens, (begin + n - 1) // sequence_tokens
            row = np.repeat(np.arange(len(n)), final - first + 1)
            window = np.arange(len(row)) - np.repeat(np.cumsum(final - first + 1) - (final - first + 1), final - first + 1) + first[row]
            left = np.maximum(window * sequence_tokens, begin[row])
            right = np.minimum((window + 1) * sequence_tokens, (begin + n)[row])
            start, length = left - begin[row], right - left
            ids = [np.frombuffer(x, dtype).astype("<u4") for x in batch.column(4).to_pylist()]
            pieces = [ids[r][s : s + k] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            padded = np.where((window + 1) * sequence_tokens > total, last_length, sequence_tokens).astype(np.int32)
            columns = [keys.take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(n[row]), pa.array(window), pa.array(left - window * sequence_tokens), pa.array(padded)]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return made.mapInArrow(run, schema)
