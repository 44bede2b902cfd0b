"""Loci over a stream of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_loci(stream: DataFrame, gap: int, lateness: str = "1 day") -> DataFrame:
    """(chrom, l, r, n) from a stream of (chrom, l, r), places in microseconds of time, in any order within the lateness.

    A locus is a session: each interval opens a window from its start to gap beyond its end, and windows that meet are
    one. Spark keeps the open loci of all keys as state. In append mode a locus is written, once, when the watermark has
    passed it, and its state goes; in complete mode all loci are written each time.
    """
    timed = stream.withColumn("_at", F.timestamp_micros("l")).withWatermark("_at", lateness)
    # a start exactly gap after an end still belongs to the locus
    window = F.session_window("_at", F.concat((F.col("r") - F.col("l") + gap + 1).cast("string"), F.lit(" microseconds")))
    loci = timed.groupBy("chrom", window.alias("_window")).agg(F.max("r").alias("r"), F.count("*").alias("n"))
    return loci.select("chrom", F.unix_micros("_window.start").alias("l"), "r", "n")
