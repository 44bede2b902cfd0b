"""MinHash fingerprints against a version in plain Python, and the order of documents with ids that many share."""

import re
import struct

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from braidline.llm import minhash

BINS, REST, MASK = 128, 57, (1 << 64) - 1


def of_long(x, seed=42):
    return xxh64_intdigest(struct.pack("<Q", x & MASK), seed)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 5:
        hashes = [xxh64_intdigest(" ".join(words).encode(), 42)]
    else:
        h = [xxh64_intdigest(w.encode(), 42) for w in words]
        hashes = [of_long(h[i] << 4 ^ h[i + 1] << 3 ^ h[i + 2] << 2 ^ h[i + 3] << 1 ^ h[i + 4]) for i in range(len(h) - 4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    least = {}
    for x in sorted(map(signed, hashes)):
        least.setdefault(x >> REST, x)
    out = []
    for b in range(-BINS // 2, BINS // 2):
        if b not in least:
            # int and long: the second's hash is seeded with the first's
            seed = xxh64_intdigest(struct.pack("<i", b), 42)
            x = min((signed(of_long(full, seed)), x) for full, x in least.items())[1]
        else:
            x = least[b]
        out.append(f"{x & 255:02x}")
    return "".join(out)


def test_fingerprints_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    odd = [(9001, None), (9002, ""), (9003, "one two"), (9004, "a b c d e"), (9005, "long " * 30_000), (9006, "é\u00a0x  y z\tw v")]
    rows = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = {r.doc_id: fingerprint(r.text) for r in rows.collect()}
    assert {r.doc_id: r.fingerprint for r in minhash.fingerprints(rows).collect()} == want


@pytest.mark.parametrize("hot", [None, 7])
def test_next_document_where_one_id_is_of_most_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 5)
    rows = [(hot, f"shared {i} " * 3) for i in range(120)] + [(i, f"own {i} " * 4) for i in range(100, 160)] + [(3, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "coalesce(doc_id, -9223372036854775808) as k").repartition(3)
    ordered, window = minhash.in_order(df, "k", "text")
    got = ordered.withColumn("next", F.lead("text").over(window)).where("not _ghost").select("k", "_h", "text", "next", "_bucket").collect()
    want = sorted(got, key=lambda r: (-r.k, r._h, r.text))
    assert len(want) == len(rows) and len({r._bucket for r in got}) > 20
    assert [r.next for r in want] == [r.text for r in [*want[1:], want[0]]]
