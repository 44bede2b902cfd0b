"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..runtime import cut
from .skew import with_groups
from .trie import trie_links

SEED = 42
#: Shingle hashes counted at a time.
AT_ONCE = 1 << 16


def simhash(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if set in over half the XXH64 of its shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone divides
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, AT_ONCE):
        size = min(AT_ONCE, n - start)
        h = np.fromiter((xxh64_intdigest(p, SEED) for p, _ in zip(parts, range(size))), ">u8", size)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null texts are empty; empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t or "", shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Fingerprints that differ in at most budget bits are linked; component_id is the smallest doc_id that links reach,
    the row's own included. All work after the fingerprints is on distinct fingerprints, so a group of equal ones, of
    any size, is one node. Null and empty texts share fingerprint 0 and are linked like any other; rows with the same
    doc_id and text are repeated; null doc_ids are passed over for component_id; other columns are dropped.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    labels = smallest_reached(nodes, "fp", cut(trie_links(nodes, "fp", budget)))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return with_groups(own, labels, "fp", ["doc_id"], own.count()).select("doc_id", digits, "component_id")


def smallest_reached(nodes: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """(node, n, component_id): the smallest least of the nodes (node, n, least) that the links (a, b) reach, for each."""
    joined = connected_components(links, "a", "b").withColumnRenamed("node", node)
    roots = cut(nodes.join(joined, node, "left").select(node, "n", "least", F.coalesce("component", node).alias("root")))
    best = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return cut(with_groups(roots.withColumnRenamed("n", "rows"), best, "root", [node], roots.count()).select(node, F.col("rows").alias("n"), "component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """The rows of docs without near-duplicates: of each component that with the smallest id stays, once. Rows with null ids stay.

    Null and empty texts are equal, and so near-duplicates of each other. See first_of_each() for ties and columns.
    """
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, shingle, budget), id_col, text_col)


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id is its component's in groups (doc_id, component_id), once: of repeated ids the first in the order of their texts (nulls first). Rows with null ids stay.

    All columns, of any names, stay as they are; they are carried along as one struct.
    """
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    kept = packed.join(stay, "key", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("text"))).where("nth = 1")
    return kept.select("row").union(packed.where("key is null").select("row")).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))
