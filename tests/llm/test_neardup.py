"""The pipeline's near-duplicate stage against brute force over five-word shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from braidline.llm import neardup
from braidline.llm.trie import trie_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def links(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(x := sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]) - len(x))]


def groups(sets, pairs):
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def near_copies(seed, families, copies, edits):
    """Texts of 100 words, each with as many copies that differ in so many places."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(families):
        base = rng.choices(words, k=100)
        out.append(" ".join(base))
        for _ in range(copies):
            new = list(base)
            for i in rng.sample(range(100), rng.randint(1, edits)):
                new[i] = rng.choice(words)
            out.append(" ".join(new))
    rng.shuffle(out)
    return out


def stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_stage_finds_near_copies_of_likeness(spark):
    texts = [*near_copies(1, 60, 3, 2), None, "", "  ", "one two", "One  two"]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = {i for i, g in groups(sets, links(sets)).items() if i == g}
    assert len(want) < len(texts) / 2
    assert stage(spark, texts) == want


@pytest.mark.parametrize("edits, families", [(2, 3), (7, 4)])
def test_crowded_buckets_by_heads(spark, monkeypatch, edits, families):
    monkeypatch.setattr(neardup, "ALL_PAIRS", 3)
    texts = near_copies(2, families, 60, edits)
    # copies of a far copy share its edits, and not the others'
    texts += [" ".join([*t.split()[:97], "tail", str(i), "end"]) for i in range(6) for t in texts[:3]]
    # and shorter ones
    texts += [" ".join(t.split()[:k]) for k in (70, 80, 90) for t in texts[:5]]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    assert stage(spark, texts) == {i for i, g in groups(sets, links(sets)).items() if i == g}


def test_blocks_are_majorities_of_hashes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300, 1000):
        s = rng.integers(0, 1 << 63, n, np.uint64)
        for i, block in enumerate(neardup.blocks_of(s, 21, 5).tolist()):
            hashes = [int(x) * int(neardup._FACTORS[i]) % 2**64 for x in s]
            ones = sum(1 << 55 - b for b in range(21) if 2 * sum(h >> 63 - b & 1 for h in hashes) > n)
            assert block == i << 56 | ones


def test_missed_pairs_are_few():
    for n in (0, 100, 10**6, 10**8):
        bits, blocks = neardup.blocks_for(n)
        assert blocks <= 1 << neardup.TAG_BITS and bits <= neardup.MOST_BITS
    rng = np.random.default_rng(4)
    bits, blocks = neardup.blocks_for(10**5)
    caught = 0
    for n in [12, 24, 80, 400] * 50:
        s = rng.integers(0, 1 << 63, n // 4 * 5, np.uint64)  # of likeness 0.8
        a, b = (neardup.blocks_of(x, bits, blocks) for x in (s, s[:n]))
        caught += (np.bitwise_count(a ^ b) <= neardup.BUDGET).any()
    assert caught >= 195


@pytest.mark.parametrize("leaf, copies", [(1 << 18, 256), (8, 22), (8, 1)])
def test_buckets_are_components_of_the_tries(spark, monkeypatch, leaf, copies):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "COPIES", copies)
    rng = random.Random(5)
    bases = [rng.getrandbits(20) for _ in range(30)]
    blocks = [[t << 56 | (rng.choice(bases) ^ (1 << rng.randrange(20) | 1 << rng.randrange(20))) << 36 for t in range(3)] for _ in range(120)]
    rows = [(i, 9, x) for i, x in enumerate(blocks)]
    got = neardup.bucketed(spark.createDataFrame(rows, "node long, size long, blocks array<long>"), len(rows), 3).collect()
    assert len(got) == 3 * len(rows)
    keys = {(r.key >> 56, r.node): r.key for r in got}
    for t in range(3):
        near = [(i, j) for i in range(120) for j in range(i) if (blocks[i][t] ^ blocks[j][t]).bit_count() <= neardup.BUDGET]
        own = groups({i: None for i in range(120)}, near)
        assert {frozenset(i for i in own if own[i] == g) for g in own.values()} == {frozenset(i for i in own if keys[t, i] == k) for k in keys.values() if k >> 56 == t}


def test_stage_takes_its_pairs_from_the_trie(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(neardup, "trie_links", lambda *args, **more: seen.append(args) or trie_links(*args, **more))
    texts = near_copies(6, 3, 2, 1)
    assert len(stage(spark, texts)) == 3 and seen


def test_a_shared_passage_is_not_compared_by_pairs(spark, monkeypatch):
    rng = random.Random(7)
    words = lambda n: [f"v{rng.getrandbits(40)}" for _ in range(n)]
    texts = near_copies(8, 1, 99, 2)
    # half of each of these texts is a passage of all, the rest stands in one neighbour each, so that no shingle is alone
    passage, tails = words(60), [words(20) for _ in range(51)]
    own = [[*passage, *tails[i], *tails[i + 1]] for i in range(50)]
    texts += [" ".join(w) for w in own]
    # and some have a near copy, in which one of the passage's words, or of the tail's, is another
    for i in range(0, 50, 10):
        for at in (30, 99):
            texts.append(" ".join([*own[i][:at], "other", *own[i][at + 1 :]]))
    arrays = [neardup.shingle_set(t) for t in texts]
    ids = [neardup.node_of(s) for s in arrays]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = spark.createDataFrame([(1, n, len(s)) for n, s in zip(ids, arrays, strict=True)], "key long, node long, size long")
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(ids)], "node long, least long")
    rows = []
    alike = neardup.alike
    monkeypatch.setattr(neardup, "alike", lambda sets, pairs: (rows.append(pairs.count()), alike(sets, pairs))[1])
    found = {(r.a, r.b) for r in neardup.crowded_links(docs, entries, nodes).collect()}
    want = groups(dict.fromkeys(ids), [(ids[a], ids[b]) for a, b in links({i: shingles(t) for i, t in enumerate(texts)})])
    assert len(set(want.values())) <= 51
    assert groups(dict.fromkeys(ids), found) == want
    assert sum(rows) < 5000
