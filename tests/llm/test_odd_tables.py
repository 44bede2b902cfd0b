"""Every operator and stage on null, empty, repeated and very long texts, repeated and null ids, an empty table, and columns whose names clash."""

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from braidline.llm.alignment import aligned
from braidline.llm.bpe import bpe
from braidline.llm.minhash import edited_fingerprints
from braidline.llm.packing import pack
from braidline.llm.pii import pseudonymized
from braidline.llm.postings import contamination
from braidline.llm.quality import judged
from braidline.llm.sharding import shard
from braidline.llm.simhash import near_duplicates, one_of_each_group
from braidline.llm.substrings import substring_dedup
from braidline.llm.tokencounts import token_counts
from braidline.llm.variants import spelling_variants
from braidline.llm.warc import write_and_read

LONG = " ".join(f"word{i % 700} of {i}" for i in range(60_000))
GOOD = "The house of the old man was near to the river and it is said that he had a boat with which he went out on it in the night for as long as the moon was there"
TEXTS = [(1, None), (2, ""), (2, ""), (None, GOOD), (None, None), (3, LONG), (4, GOOD), (5, GOOD), (5, GOOD), (6, "  \n\t "), (7, "Mr. Roe " * 30)]
CLASHES = ["key", "row", "n", "_key", "_nth", "_stay", "_again", "_doc", "_hot", "_rest", "fp", "h", "size", "part", "range", "component", "again", "copy", "digest", "c0", "_row", "_words", "classes", "kept", "_bucket", "sha1", "last", "payload", "_text", "prefix_steps", "x.y"]


def documents(spark, clash):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES)) if clash else df


OPERATORS = {
    "pack": lambda d: pack(d, path("byte_bpe_50k.json")).select("doc_id", "length", "doc_tokens", "ids_crc32").where("doc_tokens < 1000"),
    "near_duplicates": near_duplicates,
    "shard": lambda d: shard(d).select("doc_id", "size", "text_crc32"),
    "write_and_read": lambda d: write_and_read(d, "doc_id", "source", "text"),
    "token_counts": lambda d: token_counts(d, path("byte_bpe_50k.json"), with_prefixes=True).drop("prefix_steps"),
    "edited_fingerprints": lambda d: edited_fingerprints(d).select("doc_id", "n_chars", "fingerprint"),
    "judged": judged,
    "pseudonymized": lambda d: pseudonymized(d, b"test").select("doc_id", F.sha2("text", 256).alias("text"), "n_entities"),
    "substring_dedup": substring_dedup,
    "bpe": lambda d: bpe(d, path("word_bpe_49k.json")),
    "contamination": lambda d: contamination(d, spark_of(d).createDataFrame([(1, GOOD), (2, "Roe"), (None, "of"), (3, None), (1, GOOD)], "item_id long, text string")),
    "aligned": lambda d: aligned(d, path("byte_bpe_50k.json"), path("piece_bpe_32k.model")),
}


def spark_of(df):
    return df.sparkSession


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    run = OPERATORS[name]
    plain = rows(run(documents(spark, False)))
    assert rows(run(documents(spark, True))) == plain
    assert name == "pack" or sorted(map(repr, (r[0] for r in plain))) == sorted(repr(i) for i, _ in TEXTS)
    assert run(documents(spark, True).limit(0)).count() == 0


def test_spelling_variants(spark):
    plain = rows(spelling_variants(documents(spark, False), least_length=4, least_count=2))
    assert rows(spelling_variants(documents(spark, True), least_length=4, least_count=2)) == plain and len(plain) > 0
    assert spelling_variants(documents(spark, True).limit(0)).count() == 0


def own(df):
    """The rows, each with its id, text and whether all clashing columns still belong to it."""
    return [(r.doc_id, r.text, all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for c in CLASHES)) for r in df.collect()]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage(spark, name, stage):
    docs = documents(spark, True)
    made = stage(spark, docs, "")
    assert made.columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0
    got = own(made)
    assert all(x[2] for x in got)
    ids = sorted(repr(i) for i, _, _ in got)
    if name == "quality":  # too short, of repeated words, or (the long one) unlike the others
        assert ids == ["4", "5", "5", "None"]
    elif name == "near_dedup":  # texts without words are one group; rows without ids stay
        assert ids == ["1", "3", "4", "7", "None", "None"]
    elif name == "substring_dedup":
        assert ids == sorted(repr(i) for i, _ in TEXTS)
        assert sorted((repr(i), t or "") for i, t, _ in got if i in (4, 5, None)) == [("4", GOOD), ("5", ""), ("5", ""), ("None", ""), ("None", "")]
        assert sum(t is None for _, t, _ in got) == 2
    else:
        changed = {i for i, t, _ in got if t not in dict(TEXTS).values()}
        assert changed == {7} and len(got) == len(TEXTS)


def test_packing_stage(spark):
    made = corpus_pipeline.packing(spark, documents(spark, True), "")
    assert {r.doc_id for r in made.select("doc_id").distinct().collect()} == {i for i, _ in TEXTS}
    assert corpus_pipeline.packing(spark, documents(spark, True).limit(0), "").count() == 0


def test_one_of_each_group_keeps_columns(spark):
    got = own(one_of_each_group(documents(spark, True)))
    assert sorted(repr(i) for i, _, _ in got) == ["1", "3", "4", "7", "None", "None"] and all(x[2] for x in got)


def test_many_rows_without_ids(spark):
    rows = [(None, " ".join(f"w{(i * 7 + k) % 900}" for k in range(60))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup(df).collect()
    assert len(got) == 3000 and all(r.doc_id is None for r in got) and sum(r.n_words - r.n_removed for r in got) < 3000
