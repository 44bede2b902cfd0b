"""The registered queries of this subpackage: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession

from ..runtime import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import write_and_read

    return write_and_read(table(spark, sf_dir, "pages")).drop("target_uri")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The registered query's key. It is public, so others can look its surrogates up: bring your own to pseudonymized().
PII_KEY = b"key of the registered query"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymized

    return pseudonymized(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe

    return bpe(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .postings import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import aligned

    return aligned(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_sharding, op4_warc, op5_token_counts, op6_fingerprints, op7_quality_rules, op8_pii, op9_substring_dedup, op10_bpe, op11_decontamination, op12_alignment, op13_spelling_variants)}


def _quality_sql() -> str:
    from . import quality as q

    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in q.COMMON_WORDS.items())
    count = lambda pattern: f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"
    lower, upper, letter = count("[a-z]"), count("[A-Z]"), count(r"\p{L}")
    classes = f"[{lower}, {upper}, {letter} - {lower} - {upper}, {count('[0-9]')}, {count(q.CLASSES['space'])}, {count(q.CLASSES['symbol'])}]"
    means = lambda column: f"list_transform(range(1, max(len({column})) + 1), lambda i: list_avg(list_transform(list({column}), lambda x: x[i])))"
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
    distance = lambda x, y: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({x}) + 1), lambda i: ({half(f'{x}[i]', f'{y}[i]')} + {half(f'{y}[i]', f'{x}[i]')}) / 2))))"
    share = lambda x: f"list_transform({x}, lambda v: CASE WHEN list_sum({x}) > 0 THEN v / list_sum({x})::DOUBLE ELSE 0 END)"
    return rf"""
        WITH own AS (SELECT row_number() OVER () AS k, doc_id, CASE WHEN lang IN ({", ".join(map(repr, q.COMMON_WORDS))}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS text FROM documents),
        split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, CASE lang {lists} ELSE []::VARCHAR[] END AS common FROM own),
        starts AS (SELECT k, unnest(list_transform(range(1, len(ws) - {q.REPEAT_WINDOW - 2}), lambda i: {{'i': i, 'w': array_to_string(ws[i:i + {q.REPEAT_WINDOW - 1}], ' ')}})) AS x FROM split WHERE len(ws) >= {q.REPEAT_WINDOW}),
        windows AS (SELECT k, x.i AS i, count(*) OVER (PARTITION BY k, x.w) AS n FROM starts),
        repeats AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM windows, (SELECT unnest(range(0, {q.REPEAT_WINDOW})) AS j) WHERE n > 1 GROUP BY k),
        counted AS (SELECT k, doc_id, lang, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {count(q.CLASSES["symbol"])}::BIGINT AS n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {classes} AS cs,
            list_transform(common, lambda c: len(list_filter(ws, lambda w: lower(w) = c))) AS found, len(list_filter(ws, lambda w: NOT regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS bare FROM split LEFT JOIN repeats USING (k)),
        histograms AS (SELECT *, list_append(cs, length(text) - list_sum(cs)) AS c, list_concat(found, [bare, n_words - coalesce(list_sum(found), 0) - bare]) AS m, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM counted),
        shares AS (SELECT *, {share("c")} AS p, {share("m")} AS r FROM histograms),
        refs AS (SELECT lang, {means("p")} AS pr, {means("r")} AS rr FROM shares WHERE NOT base_failed GROUP BY lang),
        far AS (SELECT *, CASE WHEN word_chars >= {q.LEAST_CHARS} AND pr IS NOT NULL THEN {distance("p", "pr")} ELSE 0 END AS cd, CASE WHEN n_words >= {q.LEAST_JUDGED_WORDS} AND len(m) > 2 AND rr IS NOT NULL THEN {distance("r", "rr")} ELSE 0 END AS wd FROM shares LEFT JOIN refs USING (lang))
        SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND cd <= {q.MOST_CLASS_DISTANCE} AND wd <= {q.MOST_WORD_DISTANCE} AS kept FROM far"""


#: A hexadecimal digit group of five is four base32 digits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(sha1(p), 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)), '')"
ORACLES: dict[str, str] = {
    "op7_quality_rules": _quality_sql(),
    "op4_warc": f"""
        WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
        digested AS (SELECT page_id, octet_length(p)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest FROM own),
        lasts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM digested)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM lasts""",
    "op11_decontamination": r"""
        WITH words AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        sought AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM items WHERE len(ws) > 0)),
        starts AS (SELECT k, size, unnest(range(1, len(ws) - size + 2)) AS s, ws FROM words, (SELECT DISTINCT size FROM sought) WHERE len(ws) >= size),
        windows AS (SELECT k, size, s, array_to_string(ws[s:s + size - 1], ' ') AS w FROM starts),
        met AS (SELECT k, s, size, item_id FROM windows JOIN sought USING (size, w)),
        hit AS (SELECT k, count(DISTINCT s + i) AS n_hit FROM met, (SELECT unnest(range(0, 10)) AS i) WHERE i < size GROUP BY k),
        own AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM met GROUP BY k)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit USING (k) LEFT JOIN own USING (k)""",
    "op9_substring_dedup": r"""
        WITH own AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM own WHERE len(ws) >= 20),
        windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS w FROM starts),
        nth AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM windows),
        covered AS (SELECT doc_id, list(DISTINCT s + k) AS gone FROM nth, (SELECT unnest(range(0, 20)) AS k) WHERE n > 1 GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
        FROM own LEFT JOIN covered USING (doc_id)""",
}
