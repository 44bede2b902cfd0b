"""One-permutation MinHash fingerprints, by DataFrame functions alone."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .text import with_shingle_hashes, words

SHINGLE = 5
#: 2**BIN_BITS bins; of each bin's minimum the low LOW_BITS are stored, as two hexadecimal digits.
BIN_BITS, LOW_BITS = 7, 8
BINS = 1 << BIN_BITS
#: Rows of a bucket of consecutive documents, about, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 500, 1 << 16
_REST = 64 - BIN_BITS
#: Ids of rows without one: they come last in descending order.
_NO_ID = -(1 << 63)


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of a text column: BINS bytes as hexadecimal digits.

    A shingle's hash is taken once; its top bits name its bin, whose smallest hash counts. Empty bins are filled by
    optimal densification: each takes the value of a full bin, drawn by a random order of the bins of its own, the same
    for all texts. Texts of fewer words than a shingle have one shingle, all their words; those without words, an empty
    one. Nulls are empty texts.
    """
    w, h, g, s, m, f = (f"_{out}_{x}" for x in "whgsmf")
    df = df.withColumn(w, words(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    df = with_shingle_hashes(df, h, shingle, g)
    df = df.withColumn(s, F.sort_array(F.when(F.size(h) < shingle, whole).otherwise(F.transform(g, lambda x: F.xxhash64(x)))))
    sorted_ = F.col(s)
    df = df.withColumn(m, F.filter(sorted_, lambda x, i: (i == 0) | (F.shiftright(x, _REST) != F.shiftright(sorted_[F.greatest(i - 1, F.lit(0))], _REST))))
    minima = F.col(m)
    empty = F.array_except(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), F.transform(m, lambda x: F.shiftright(x, _REST).cast("int")))

    def filled(bin_: Column) -> Column:
        drawn = F.array_min(F.transform(minima, lambda x: F.struct(F.xxhash64(bin_, F.shiftright(x, _REST)).alias("r"), x.alias("x"))))["x"]
        return F.shiftleft(bin_.cast("long"), _REST).bitwiseOR(drawn.bitwiseAND(F.lit((1 << _REST) - 1)))

    df = df.withColumn(f, F.sort_array(F.concat(minima, F.transform(empty, filled))))
    low = F.transform(f, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << LOW_BITS) - 1))), 2, "0"))
    return df.withColumn(out, F.lower(F.array_join(low, ""))).drop(w, h, g, s, m, f)


def likeness(a: str, b: str) -> Column:
    """The Jaccard likeness that two fingerprint columns tell of, from 0 to 1.

    Bins of different shingles agree in their low bits by chance once in 2**LOW_BITS; that share is taken off.
    """
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + (F.substr(F.col(a), i * 2 + 1, F.lit(2)) == F.substr(F.col(b), i * 2 + 1, F.lit(2))).cast("int"))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance))


def _numbers(values: list[int], kind: str) -> Column:
    """A constant array: one string in the plan, however many numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _bucket(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most the key: counted over every 256th, then over those between two of them."""
    coarse = F.size(F.filter(_numbers(splitters[::256], "bigint"), lambda x: x <= key))
    inner = F.slice(_numbers(splitters, "bigint"), F.greatest(coarse - 1, F.lit(0)) * 256 + 1, F.lit(256))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 256 + F.size(F.filter(inner, lambda x: x <= key)))


def in_order(docs: DataFrame, key: str, tie: str, bucket_rows: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """(rows, window): with lead(...).over(window) each row sees the one that follows in descending order of the long key (equal keys: by tie's hash, then tie, ascending); the last sees the first.

    Rows go to buckets by quantiles of the key and are put in order within each; a key that several quantiles fall on has
    as many buckets, divided by tie's hash. A bucket also gets a copy, marked _ghost, of the first row of the bucket that
    follows. A bucket has about bucket_rows rows, more only in tables of over MOST_BUCKETS times that; within it the
    window spills. The quantiles and first rows' keys, at most twice MOST_BUCKETS, pass through the driver.
    """
    buckets = max(1, min(MOST_BUCKETS, docs.count() // (bucket_rows or BUCKET_ROWS)))
    at = [i / buckets for i in range(1, buckets)]
    quantiles = Counter(docs.select(F.percentile_approx(key, at, max(10_000, 4 * buckets))).first()[0] or []) if at else Counter()
    hot = {q: times + 1 for q, times in quantiles.items() if times > 1}
    splitters = sorted({*quantiles, *(q + 1 for q in hot if q + 1 < 1 << 63)})
    parts = [1, *(hot.get(q, 1) for q in splitters)]
    docs = docs.withColumn("_h", F.xxhash64(tie)).withColumn("_range", _bucket(F.col(key), splitters))
    docs = docs.withColumn("_parts", F.get(_numbers(parts, "int"), "_range") if hot else F.lit(1))
    # the hash's share of its range, of so many parts
    part = F.least(F.floor((F.shiftright("_h", 1) / F.lit(float(1 << 63)) + 0.5) * F.col("_parts")), F.col("_parts") - 1)
    docs = docs.withColumn("_bucket", F.col("_range").cast("long") * MOST_BUCKETS + part).drop("_range", "_parts")
    firsts = {r[0]: r[1] for r in docs.groupBy("_bucket").agg(F.min(F.struct(F.bitwise_not(key).alias("k"), "_h"))).collect()}
    order = sorted(firsts, key=lambda b: (-(b // MOST_BUCKETS), b % MOST_BUCKETS))
    borrowed = [(~firsts[b].k, firsts[b]._h, order[i - 1]) for i, b in enumerate(order)]  # the first bucket's row goes to the last bucket
    rows, window = docs.withColumn("_ghost", F.lit(False)), Window.partitionBy("_bucket").orderBy("_ghost", F.desc(key), "_h", tie)
    if not borrowed:
        return rows, window
    small = F.broadcast(docs.sparkSession.createDataFrame(borrowed, "_first long, _first_h long, _to long"))  # a row for each bucket
    found = docs.join(small, (F.col(key) == F.col("_first")) & (F.col("_h") == F.col("_first_h"))).groupBy("_to").agg(F.min_by(F.struct(*docs.columns), tie).alias("row"))
    ghosts = found.select("row.*", F.lit(True).alias("_ghost"), "_to").withColumn("_bucket", F.col("_to")).drop("_to")
    return rows.unionByName(ghosts), window


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of every row; see with_fingerprint. Null texts are empty, null ids stay, other columns are dropped."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_fingerprint(own, "text", "fingerprint", shingle).select("doc_id", "fingerprint")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Of every row: doc_id, n_chars, its fingerprint, that of its edited text, and the likenesses.

    The edited text has the last floor(n_chars / 3) characters replaced by the first as many (or all) of the next
    document, in descending order of doc_id; after the last comes the first, and a lone document follows itself. Null
    texts are empty. Rows with the same doc_id come in the order of their texts' hashes; null ids come last. Repeated rows
    give repeated rows, other columns are dropped, an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("_key", F.coalesce("doc_id", F.lit(_NO_ID)))
    rows, window = in_order(own, "_key", "text")
    rows = with_fingerprint(rows, "text", "fingerprint", shingle)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in ("text", "fingerprint")}).where("not _ghost")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.expr("cast(floor(n_chars / 3) as int)"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int")), F.substr("next_text", F.lit(1), F.col("_cut")))
    rows = rows.withColumn("_edited", edited).select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "_edited")
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint", shingle)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
