"""Postings, tokenizer alignment and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from braidline.llm import alignment, postings, variants

SF = "/root/testdata/sf0.001"
ODD = ["", None, "  a  b\n\n c", "foo<|endoftext|> bar <|endoftext|>x <s>hi</s>", "it's we'll  'll  x'\x1cy \x1c z they're", "a ́b ﬁ İΣ", "日本語 テキスト です", "\x85 \xa0x  y", "trail ", " lead", " \n x", "é " * 5, "x" * 3000, "a▁b c", "nul\x00 here", "<0x41> \t tab", "A​b ﻿x 🙂🙂 🙂"]


def frame(spark, texts, ids=None):
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# postings


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    for doc, t in texts:
        w, hit, own = words_of(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    own |= found
        ids = sorted(str(i) for i in own if i is not None)
        yield doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [postings.BLOCK_BYTES, 2000])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("the of and a to in Ä b9 ЖЖ".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(60)] + [(7, text(4)), (None, text(12)), (100, None), (101, " ,; ")]
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items += [(200, long), (201, long), (202, "Beta, gamma")]
    texts = [(i, text(rng.randrange(0, 90))) for i in range(80)] + [(None, f"x {long} y"), (3, long.upper()), (3, None), (4, ""), (5, f"{long}. {long}"), (6, "beta"), (6, "gamma")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = postings.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert sorted(map(repr, (tuple(r)[:-1] for r in got.collect()))) == sorted(map(repr, contaminated(texts, items)))
    for r in got.collect():
        assert r.items == sorted(r.items) and len(r.items) == r.n_items


def test_lists_are_stored_packed(spark):
    """Spark's readers hold a slice's lists as three values, all smaller than the text; as arrays of terms they filled the executors' heaps."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2000)) for _ in range(100)]
    index = postings.positional_index(frame(spark, texts))
    assert {k: v for k, v in index.dtypes if k in ("terms", "sizes", "postings")} == dict.fromkeys(("terms", "sizes", "postings"), "binary")
    assert index.selectExpr("sum(length(terms) + length(sizes) + length(postings)) AS n").first().n < 0.7 * sum(map(len, texts))


def test_contamination_of_nothing(spark):
    docs, none = frame(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.n_items, r.contaminated) for r in postings.contamination(docs, none).collect()] == [(0, 0, False)] * 2
    assert postings.contamination(docs.limit(0), none).count() == 0


def test_without_contaminated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "q r", "y"), (None, None, "z")], "doc_id long, text string, item string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert sorted(r.item for r in postings.without_contaminated(docs, items).collect()) == ["y", "z"]
    assert sorted(r.item for r in postings.without_contaminated(docs, items, most_share=0.5).collect()) == ["x", "y", "z"]


def test_found_phrases_and_proximity(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randrange(0, 40))) for _ in range(60)]
    index = postings.positional_index(frame(spark, texts))
    queries = [(n, " ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 4])))) for n in range(40)]
    df = spark.createDataFrame([(n, bytearray(q.encode())) for n, q in queries], "item long, query binary")
    got = sorted((r.id, r.item, r.start, r.stop) for r in postings.found(index, df).collect())
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        for n, q in queries:
            x = q.split()
            want += [(i, n, k, k + len(x)) for k in range(len(w) - len(x) + 1) if w[k : k + len(x)] == x]
    assert got == sorted(want) and want
    for within in (1, 3, 6):
        got = sorted((r.id, r.item, r.start, r.stop) for r in postings.found(index, df, within=within).collect())
        want = []
        for i, t in enumerate(texts):
            w = t.split()
            for n, q in queries:
                x = set(q.split())
                runs = [(a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + within) + 1) if x <= set(w[a:b])]
                want += [(i, n, *r) for r in runs if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in runs)]
        assert got == sorted(want)


# alignment


@pytest.mark.parametrize("few", [0, alignment._FEW])
def test_common_ends_are_all(monkeypatch, few):
    monkeypatch.setattr(alignment, "_FEW", few)
    rng = random.Random(2)
    for _ in range(500):
        a, b, firsts, at = [], [], [], 0
        for _ in range(rng.randrange(1, 50)):
            n = rng.choice([1, 3, 10, 60, 400])
            firsts.append((len(a), len(b)))
            for x in (a, b):
                x += [at + k for k in [*sorted(rng.sample(range(1, n), min(n - 1, rng.choice([0, 3, n // 2, n])))), n]]
            at += n
        i, j = (np.array(x) for x in zip(*firsts, strict=True))
        ends = [np.append(x[1:], len(y)) - 1 for x, y in ((i, a), (j, b))]
        found = alignment.common_ends(np.array(a), np.array(b), i, ends[0], j, ends[1])
        assert [*zip(*(x.tolist() for x in found), strict=True)] == [(k, bisect_left(b, x)) for k, x in enumerate(a) if x in b]


def brute_alignment(texts):
    import sentencepiece

    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    byte = {c: n for n, c in alignment.BYTE_SYMBOLS.items()}
    a_bytes = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made = []
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(map(a_bytes, x)) != whole or b"".join(map(b_bytes, y)) != whole:
            made.append(([], [], [], []))
            continue
        ends = []
        for ids, of in ((x, a_bytes), (y, b_bytes)):
            at, own = 0, []
            for i in ids:
                at += len(of(i))
                own.append(at)
            ends.append(own)
        shared, groups, links, p, q = sorted(set(ends[0]) & set(ends[1])), [], [], 0, 0
        for e in shared:
            i, j = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, x[p:i])) + "|" + ",".join(map(str, y[q:j])))
            links.append((x[i - 1], y[j - 1]))
            p, q = i, j
        made.append((x, y, groups, links))
    counts = Counter(pair for m in made for pair in m[3])
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    for x, y, groups, links in made:
        shown = ";".join(groups)
        yield len(x), len(y), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown


def test_alignment_equals_brute_force(spark, docs):
    rng = random.Random(3)
    texts = ODD + [r.text[:3000] if r.text else r.text for r in docs.collect()][:120] + ["".join(rng.choices(" ab\n'slvreé中<|\t1É▁", k=40)) for _ in range(300)]
    got = alignment.aligned(frame(spark, texts), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), with_groups=True)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    own = {r.doc_id: tuple(r[c] for c in columns) for r in got.collect()}
    for i, want in enumerate(brute_alignment(texts)):
        assert own[i] == want, repr(texts[i])
    made = alignment.alignments(frame(spark, texts), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert sum(r.n for r in alignment.link_counts(made).collect()) == sum(v[3] for v in own.values())


def test_alignment_of_nothing(spark):
    paths = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
    assert alignment.aligned(frame(spark, ["a"]).limit(0), *paths).count() == 0
    (row,) = alignment.aligned(frame(spark, [None]), *paths).collect()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "")


# spelling variants


def brute_counts(texts, least=6, period=199):
    counts = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % period == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        if vs and counts[best := min(vs, key=lambda v: (-counts[v], v))] >= times * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))


def test_word_counts(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "Straße ÄÖÜäöü nothing"), (5, None), (5, "")] + [(i, "Überraschung × ÷÷÷÷÷÷÷ " + "x" * 100 + " " + "é" * 70) for i in range(400)]
    got = variants.word_counts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert {r.word: r.n for r in got.collect()} == brute_counts(texts)


@pytest.mark.parametrize("most", [variants.MOST_WORDS, 70, 4])
def test_near_words(spark, most):
    rng = random.Random(4)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 8))) for _ in range(1500)} | {"a" * n for n in range(1, 40)} | {"prefix" + "".join(rng.choices("xyz", k=5)) for _ in range(150)} | {"z" * 300 + "q", "z" * 300}
    got = [tuple(r) for r in variants.near_words(spark.createDataFrame([(w,) for w in words], "word string"), most).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_spelling_variants_equal_brute_force(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(i, "colour color " * (i % 7) + "colouur " * (i % 3)) for i in range(300)] + [(9, "wordaa wordab wordac " * 5), (9, "wordaa wordab wordac " * 5)] + [(10, "chainaaa " * 5 + "chainaab " * 25 + "chainabb " * 125 + "chainbbb " * 625)]
    got = variants.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    counts = {w: n for w, n in brute_counts(texts).items() if n >= 5}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_variants(counts)))
    assert got.where("root = 'chainbbb'").count() == 4
    assert variants.spelling_variants(docs.limit(0)).count() == 0
