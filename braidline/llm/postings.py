"""Benchmark decontamination by a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release
from .chunks import in_slices

WINDOW = 10
#: Query rows that are broadcast at a time, by their bytes; more queries go in further blocks over the same index.
BLOCK_BYTES = 16_000_000
#: Candidate places that are intersected at a time.
AT_ONCE = 2_000_000
#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space; all other bytes belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of the contract: runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z."""
    return text.encode().translate(_FOLD).split()


def _packed(raw: bytes) -> bytes:
    """Compressed, behind its length. A slice's lists pass Spark's readers and writers as three such values: as arrays of single terms, or unpacked, they took most of an executor's memory."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(value: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(value)[8:], int.from_bytes(value[:8], "little"), asbytes=True)


class _Interned(dict):
    """Numbers in the order of first appearance."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows, written to the shared folder, a row for each slice of documents: (part, ids, n_words, terms, sizes, postings).

    Words are counted through the slice: ids and n_words are those of its documents in order. A term has sizes[i]
    postings, the places of its words in ascending order, kept as gaps of 32 bits. terms (joined by a space), sizes and
    postings are packed. Null texts have no words; null and repeated ids stay rows of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in in_slices(texts):
                number = _Interned()
                parts, counts = [], []
                for t in texts[s]:
                    words = words_of(t)
                    counts.append(len(words))
                    parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                terms = np.concatenate(parts)
                # 16-bit numbers are sorted by radix
                order = np.argsort(terms.astype(np.uint16) if len(number) <= 1 << 16 else terms, kind="stable").astype(np.int32)
                sizes = np.bincount(terms, minlength=len(number))
                gaps = np.diff(order, prepend=np.int32(0))
                firsts = np.cumsum(sizes) - sizes
                gaps[firsts] = order[firsts]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                packed = (pa.array([_packed(raw)], pa.binary()) for raw in (b" ".join(number), sizes.astype(np.int32).tobytes(), gaps.tobytes()))
                columns = [one(batch.column(0)[s]), one(pa.array(counts, pa.int64())), *packed]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "n_words", "terms", "sizes", "postings"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"ids array<{kind}>, n_words array<bigint>, terms binary, sizes binary, postings binary")
    return cut(rows.withColumn("part", F.monotonically_increasing_id()))


class _Lists:
    """A slice's posting lists of the terms asked for."""

    def __init__(self, row: dict, terms: pa.Array):
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.ends = np.cumsum(self.n_words)
        sizes = np.frombuffer(_unpacked(row["sizes"]), np.int32).astype(np.int64)
        firsts = np.cumsum(sizes) - sizes
        found = pc.index_in(terms, value_set=pa.array(_unpacked(row["terms"]).split(), pa.binary()))
        here = np.asarray(found.is_valid())
        at = np.asarray(found.fill_null(0))
        gaps = np.frombuffer(_unpacked(row["postings"]), np.int32)
        #: By number of a term: how many places it has, and where they begin.
        self.sizes = np.where(here, sizes[at] if len(sizes) else 0, 0)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        lists = [np.cumsum(gaps[firsts[i] : firsts[i] + sizes[i]], dtype=np.int64) for i in at[here]]
        self.places = np.concatenate(lists) if lists else np.empty(0, np.int64)
        #: Term and place in one number, ascending: all lists one after the other.
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), self.sizes) << 32 | self.places

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each place is in its term's list."""
        key = terms << 32 | places
        at = np.searchsorted(self.keys, key)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) & (places >= 0)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")

    def phrases(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, start) of all places of the phrases, rows of term numbers, inside one document.

        Each phrase starts from the list of its rarest term, less that term's offset, and meets the other terms' lists
        from the rarer to the more frequent.
        """
        sizes = self.sizes[queries]
        alive = np.flatnonzero(sizes.min(axis=1) > 0)
        rarest_first = np.argsort(sizes[alive], axis=1, kind="stable")
        n = sizes[alive, rarest_first[:, 0]] if len(alive) else np.empty(0, np.int64)
        for block in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(np.cumsum(n) // AT_ONCE)) + 1) if len(alive) else ():
            q = np.repeat(block, n[block])
            nth = np.arange(len(q)) - np.repeat(np.cumsum(n[block]) - n[block], n[block])
            offset = rarest_first[q, 0]
            start = self.places[self.firsts[queries[alive[q], offset]] + nth] - offset
            for k in range(1, queries.shape[1]):
                offset = rarest_first[q, k]
                stays = self.has(queries[alive[q], offset], start + offset)
                q, start = q[stays], start[stays]
            inside = (start >= 0) & (self.doc_of(start) == self.doc_of(start + queries.shape[1] - 1))
            yield alive[q[inside]], start[inside]

    def near(self, query: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of the smallest runs of at most so many words of one document that hold all the query's terms, none inside another.

        Only places around the rarest term's are looked at.
        """
        terms = np.unique(query)
        lists = sorted((self.places[self.firsts[t] : self.firsts[t] + self.sizes[t]] for t in terms), key=len)
        none = np.empty(0, np.int64)
        if not len(lists) or not len(lists[0]):
            return none, none
        rare = lists[0]
        starts = []
        for x in lists:
            at = np.searchsorted(rare, x)  # the next place of the rarest term at or after, and the last before
            after = rare[np.minimum(at, len(rare) - 1)] - x
            before = x - rare[np.maximum(at - 1, 0)]
            starts.append(x[((after >= 0) & (after < within)) | ((before >= 0) & (before < within))])
        starts = np.unique(np.concatenate(starts))
        last = np.zeros(len(starts), np.int64)
        for x in lists:
            at = np.searchsorted(x, starts)
            last = np.maximum(last, np.where(at < len(x), x[np.minimum(at, len(x) - 1)], np.int64(1) << 40))
        good = last - starts < within
        starts, last = starts[good], last[good]
        good = self.doc_of(starts) == self.doc_of(last)
        starts, last = starts[good], last[good]
        smallest = np.append(np.diff(last) > 0, True) if len(last) else np.empty(0, bool)  # of one end, the latest start
        return starts[smallest], last[smallest] + 1


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(query, item): the distinct windows of so many consecutive words of each text (the whole of a shorter one), joined by a space, with the text's id."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text or "")
                made = list({b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}) if words else []
                for k in range(0, len(made), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(made[k : k + 10_000], pa.binary()), batch.column(0).take(pa.array([i] * len(made[k : k + 10_000])))], names=["query", "item"])

    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"query binary, item {kind}").distinct()


class _Block:
    """Queries that fit a broadcast: their terms, and by number of words a matrix of term numbers, with the items of each query."""

    def __init__(self, rows: list):
        items: dict[bytes, list] = {}
        for r in rows:
            items.setdefault(bytes(r.query), []).append(r.item)
        number = _Interned()
        by: dict[int, list] = {}
        for query, own in items.items():
            ids = [number[w] for w in query.split()]
            by.setdefault(len(ids), []).append((ids, own))
        self.terms = list(number)
        self.by = {n: (np.array([x for x, _ in rows], np.int64), [own for _, own in rows]) for n, rows in by.items()}


def _blocks(spark, queries: DataFrame, most: int) -> Iterator:
    """The queries in broadcasts of about so many bytes; each passes through the driver by itself."""
    queries = cut(queries)
    total = queries.agg(F.sum(F.length("query") + 64).alias("n")).first().n or 0
    n = -(-total // most)
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(n)) == b).collect()
        if rows:
            yield spark.sparkContext.broadcast(_Block(rows))


def _over(index: DataFrame, schema: str, answer) -> DataFrame:
    """answer(row of the index) for all rows, only whose columns that it needs are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: (v.values if c == "n_words" else v.as_py()) for c, v in row.items()}
                yield from answer(row)

    return index.select("part", "n_words", "terms", "sizes", "postings").mapInArrow(run, schema)


def _union(made: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in made:
        out = df if out is None else out.union(df)
    return out


def found(index: DataFrame, queries: DataFrame, within: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, part, at, start, stop): where each query (query: words joined by a space; item: its id) occurs in the indexed documents.

    As an exact phrase; or, with within, in any order and with other words between, in runs of so many words at most: the
    smallest ones, none inside another. part and at tell rows with the same id apart; start and stop count the document's words.
    """
    spark = index.sparkSession
    kind = queries.schema["item"].dataType.simpleString()

    def answering(block):
        def answer(row: dict) -> Iterator[pa.RecordBatch]:
            own = block.value
            lists = _Lists(row, pa.array(own.terms, pa.binary()))
            for n, (matrix, items) in own.by.items():
                if within is None:
                    hits = lists.phrases(matrix)
                else:
                    hits = ((np.full(len(x[0]), q), x) for q in range(len(matrix)) for x in [lists.near(matrix[q], within)])
                for q, place in hits:
                    start, stop = place if within is not None else (place, place + n)
                    of = np.array([len(items[i]) for i in q], np.int64)
                    doc = np.repeat(lists.doc_of(start), of)
                    base = (lists.ends - lists.n_words)[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), row["part"])), pa.array(doc), pa.array([x for i in q for x in items[i]], pa.array([x for own in items for x in own]).type), pa.array(np.repeat(start, of) - base), pa.array(np.repeat(stop, of) - base)], names=["part", "at", "item", "start", "stop"])

        return answer

    made = [_over(index, f"part long, at long, item {kind}, start long, stop long", answering(b)) for b in _blocks(spark, queries, block_bytes)]
    ids = index.select("part", F.posexplode("ids").alias("at", "id")).withColumn("at", F.col("at").cast("long"))
    hits = _union(made)
    if hits is None:
        hits = spark.createDataFrame([], f"part long, at long, item {kind}, start long, stop long")
    return hits.join(ids, ["part", "at"]).select("id", "item", "part", "at", "start", "stop")


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true values."""
    steps = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _hits(row: dict, own: _Block) -> Iterator[pa.RecordBatch]:
    """(part, at, start, stop, items) of a slice's documents that any query of the block hits: the runs of words hit, and the items."""
    lists = _Lists(row, pa.array(own.terms, pa.binary()))
    marks = np.zeros(int(lists.ends[-1]) + 1 if len(lists.ends) else 1, np.int32)
    items: dict[int, set] = {}
    for n, (matrix, owners) in own.by.items():
        for q, start in lists.phrases(matrix):
            np.add.at(marks, start, 1)
            np.add.at(marks, start + n, -1)
            for doc, i in np.unique(np.stack([lists.doc_of(start), q], axis=1), axis=0).tolist() if len(q) else ():
                items.setdefault(doc, set()).update(owners[i])
    if not items:
        return
    covered = np.cumsum(marks[:-1]) > 0
    out = []
    for doc in sorted(items):
        first, last = lists.ends[doc] - lists.n_words[doc], lists.ends[doc]
        out.append((doc, *_runs(covered[first:last]), [str(i) for i in items[doc] if i is not None]))
    longs = lambda k: pa.array([o[k] for o in out], pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()), longs(1), longs(2), pa.array([o[3] for o in out], pa.list_(pa.string()))], names=["part", "at", "start", "stop", "items"])


def _covered_words(runs: Column) -> Column:
    """How many words the runs (start, stop) of all blocks cover together."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["stop"]).alias("reach"))
    return F.aggregate(F.array_sort(runs), none, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id column, n_words, n_hit, n_items, items_sha256, contaminated of every row, and items (the item ids as strings, sorted).

    A window is size consecutive words of an item, or all words of an item that has fewer. A document word inside any
    occurrence of a window is hit. All documents are indexed once; the windows are looked up in the lists of each slice,
    in blocks of bounded size, so the items may be as many as they like. Null texts have no words; items without words
    have no windows; an item without an id hits, but is not listed; items of one id count once. Null and repeated
    document ids stay rows of their own, other columns are dropped, an empty table gives no rows.
    """
    spark = docs.sparkSession
    release(spark)
    index = positional_index(docs, id_col, text_col)
    hits = _union([_over(index, "part long, at long, start array<bigint>, stop array<bigint>, items array<string>", lambda row, b=b: _hits(row, b.value)) for b in _blocks(spark, windows_of(items, item_id_col, item_text_col, size), block_bytes)])
    rows = index.select("part", F.posexplode(F.arrays_zip("ids", "n_words")).alias("at", "x")).select("part", F.col("at").cast("long").alias("at"), F.col("x.ids").alias("_id"), F.col("x.n_words").alias("n_words"))
    if hits is None:
        rows = rows.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    else:
        hits = hits.groupBy("part", "at").agg(F.flatten(F.collect_list(F.arrays_zip("start", "stop"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hits = hits.select("part", "at", _covered_words(F.col("runs")).alias("n_hit"), "items")
        rows = rows.join(hits, ["part", "at"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return rows.select(F.col("_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_share: float = 0.0) -> DataFrame:
    """The documents of which no more than that share of the words is hit, with all their columns; see contamination()."""
    names = docs.columns
    own = cut(docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("_all")).withColumn("_row", F.monotonically_increasing_id()))
    judged = contamination(own.select("_row", F.col(f"_all.c{names.index(text_col)}").alias("_text")), items, "_row", "_text").where(F.col("n_hit") > most_share * F.col("n_words"))
    return own.join(judged.select("_row"), "_row", "left_anti").select(*(F.col(f"_all.c{i}").alias(c) for i, c in enumerate(names)))
