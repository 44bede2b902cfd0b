"""Column expressions over the words of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the contracts have it; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of other characters than SPACE."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def with_shingle_hashes(df: DataFrame, hashes: str, size: int, out: str) -> DataFrame:
    """Adds a hash of each so many consecutive elements of an array column of hashes; none where there are fewer.

    The elements are shifted by their distance from the window's end, and added bit by bit, which costs far less in
    expressions than a hash of so many inputs; equal windows have equal hashes, and others differ as random 64-bit
    hashes do. A window is made of two parts, so size 8 takes three steps. Each step is a column of its own, as a nested
    expression would be evaluated once for each mention.
    """

    def step(a: str, n_a: int, b: str, n_b: int, name: str) -> DataFrame:
        # element i stands for the n_a elements from i on, and the n_b after them
        n = F.greatest(F.size(hashes) - F.lit(n_a + n_b - 1), F.lit(0))
        return df.withColumn(name, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(n_a + 1), n), lambda x, y: F.shiftleft(x, n_b).bitwiseXOR(y)))

    parts, n = {1: hashes}, 1
    while 2 * n <= size:
        parts[2 * n] = f"_{out}_{2 * n}"
        df, n = step(parts[n], n, parts[n], n, parts[2 * n]), 2 * n
    made = n
    for bit in sorted(parts, reverse=True):
        if bit < n and size & bit:
            name = f"_{out}_{made + bit}"
            df = step(parts[n] if made == n else f"_{out}_{made}", made, parts[bit], bit, name)
            made += bit
    last = parts[n] if made == n else f"_{out}_{made}"
    return df.withColumn(out, F.col(last)).drop(*(c for c in df.columns if re.fullmatch(rf"_{re.escape(out)}_\d+", c)))
