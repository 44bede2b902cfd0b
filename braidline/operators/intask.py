"""Steps on many small graphs at once: whole graphs of bounded size in a task, by arrays; larger ones are left to rounds of jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import is_empty, ship

#: Up to so many rows a graph is held by one task.
MOST_ROWS = 1 << 16
#: Rows that a task takes at a time.
AT_ONCE = 1 << 17


def by_size(rows: DataFrame, keys: list[str], most: int | None = MOST_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows of graphs (keys) of at most so many rows, and those of larger graphs, if there are any. rows are counted by a job, but not with None: then none are known to be large."""
    if most is None:
        return rows, None
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys)
    if is_empty(large):
        return rows, None
    return rows.join(large, keys, "left_anti").select(*rows.columns), rows.join(large, keys, "left_semi").select(*rows.columns)


def in_tasks(rows: DataFrame, keys: list[str], schema: str | StructType, step: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """What step makes of the rows, dealt by the keys: it gets whole graphs, many at a time, with the number of each row's graph, ascending from 0."""

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                table = pa.Table.from_batches(held).combine_chunks()
                graph = numbers(table)
                whole = int(np.searchsorted(graph, graph[-1]))  # the last one may go on
                if whole:
                    yield from step(table.slice(0, whole).combine_chunks(), graph[:whole]).to_batches()
                rest = table.slice(whole)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from step(table, numbers(table)).to_batches()

    ship(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def ends_of(graph: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(s, t, v, graph of v): the ends of edges as numbers of vertices, ascending by graph and vertex; v has the vertices' own numbers."""
    names, at = np.unique(np.concatenate([s, t]), return_inverse=True)
    both = np.concatenate([graph, graph]) * np.int64(max(1, len(names))) + at
    found, at = np.unique(both, return_inverse=True)
    return at[: len(s)], at[len(s) :], names[found % max(1, len(names))], found // max(1, len(names))
