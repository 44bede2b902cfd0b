"""Quality rules by distribution divergence, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .text import with_shingle_hashes, words

#: The base rules: fewest words, and the most words, in percent, inside repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8
#: Very common words of the languages, as they stand in running text.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on this are or an from at not have but which has they you he".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er aus bei nach wie am".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il avec son sont aux ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me".split(),
}
#: Characters of each class, by Java's regular expressions; what is left over is a class of its own.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "letter": r"[\p{L}&&[^a-zA-Z]]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "symbol": r"[#*$%&|<>]"}
#: Jensen-Shannon distances (base 2, 0 to 1) to the language's reference beyond which a document is rejected, and the characters and words from which a histogram is judged at all.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.35
LEAST_CHARS, LEAST_JUDGED_WORDS = 400, 60


def _repeat_words() -> Column:
    """Words inside windows of REPEAT_WINDOW words that the text has at least twice, from the column _windows of their hashes.

    Only texts with a repeated window pay for more than a count of distinct ones: their windows are sorted by hash, the
    repeated ones put in the order of their starts, and each adds the words up to the next.
    """
    w = "_windows"
    paired = f"array_sort(transform({w}, (x, i) -> struct(x as x, i as i)))"
    # the starts of repeated windows, in order
    starts = (
        f"aggregate(array({paired}), cast(array() as array<int>), (none, s) -> array_sort(transform(filter(transform(s, (p, k) -> "
        "struct(p.i as i, (k > 0 and s[greatest(k - 1, 0)].x = p.x) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = p.x) as twice)), q -> q.twice), q -> q.i)))"
    )
    covered = f"aggregate(array({starts}), 0L, (none, s) -> cast(aggregate(transform(s, (p, k) -> if(k < size(s) - 1, least({REPEAT_WINDOW}, s[least(k + 1, size(s) - 1)] - p), {REPEAT_WINDOW})), 0L, (n, x) -> n + x) as bigint))"
    return F.expr(f"if(size({w}) = size(array_distinct({w})), 0L, {covered})")


def _counted_classes(df: DataFrame) -> DataFrame:
    """Adds classes, the counts of the text's character classes, and what is left over.

    A class's runs are taken out, then the next one's from what is left: the first takes most of a text, run by run,
    and the others go over little.
    """
    left, counts = "text", []
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_without_{name}", F.regexp_replace(left, f"{pattern}+", ""))
        counts.append(F.length(left) - F.length(f"_without_{name}"))
        left = f"_without_{name}"
    return df.withColumn("classes", F.array(*counts, F.length(left)))


def _counted_words(df: DataFrame) -> DataFrame:
    """Adds common: the counts of each of the language's common words, of words without a letter or digit, and of all others."""
    listed = {lang: ", ".join(f"'{w}'" for w in ws) for lang, ws in COMMON_WORDS.items()}
    found = " ".join(f"when '{lang}' then filter(transform(_words, w -> lower(w)), w -> w in ({ws}))" for lang, ws in listed.items())
    df = df.withColumn("_found", F.expr(f"case lang {found} else cast(array() as array<string>) end"))
    # each found word between spaces of its own: taking one word out shortens the whole by its bytes
    df = df.withColumn("_line", F.expr("concat(' ', array_join(_found, '  '), ' ')"))
    count = lambda w: f"(octet_length(_line) - octet_length(replace(_line, ' {w} ', ''))) div {len(w.encode()) + 2}"
    each = " ".join(f"when '{lang}' then array({', '.join(map(count, ws))})" for lang, ws in COMMON_WORDS.items())
    df = df.withColumn("_each", F.expr(f"cast(case lang {each} else cast(array() as array<bigint>) end as array<int>)"))
    bare = F.size(F.filter("_words", lambda w: ~w.rlike(r"[\p{L}\p{N}]")))
    df = df.withColumn("_bare", bare)
    return df.withColumn("common", F.concat("_each", F.array("_bare", F.size("_words") - F.size("_found") - F.col("_bare"))))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the contract's counts, and both histograms, of every row. docs: doc_id, lang, text (no nulls)."""
    df = docs.withColumn("_words", words(F.col("text")))
    df = with_shingle_hashes(df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))), "_hashes", REPEAT_WINDOW, "_windows")
    df = df.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _counted_words(_counted_classes(df))
    of_class = {c: F.col("classes")[i].cast("long") for i, c in enumerate(CLASSES)}
    return df.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        (F.length("text") - of_class["space"]).cast("long").alias("word_chars"),
        of_class["symbol"].alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"),
        "classes",
        "common",
    )


def _share(histogram: str) -> Column:
    """Each count's share of their total, which is the column of that name after "_all_"."""
    return F.transform(histogram, lambda x: F.when(F.col(f"_all_{histogram}") > 0, x / F.col(f"_all_{histogram}")).otherwise(F.lit(0.0)))


def _js_distance(p: str, q: str) -> Column:
    """The Jensen-Shannon distance of two columns of shares: the root of the divergence to their mean, in bits."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda n, x: n + x)))


def _own(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, text, and the row that they are of."""
    lang = F.col(f"_row.{lang_col}").cast("string")
    return docs.select(F.struct("*").alias("_row")).select(F.col(f"_row.{id_col}").cast("long").alias("doc_id"), F.when(lang.isin(*COMMON_WORDS), lang).otherwise("").alias("lang"), F.coalesce(F.col(f"_row.{text_col}").cast("string"), F.lit("")).alias("text"), "_row")


def _shares(made: DataFrame) -> DataFrame:
    made = made.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    for histogram in ("classes", "common"):
        made = made.withColumn(f"_all_{histogram}", F.aggregate(histogram, F.lit(0), lambda n, x: n + x)).withColumn(histogram, _share(histogram))
    return made.drop("_all_classes", "_all_common")


def references(made: DataFrame) -> DataFrame:
    """A row for each language of COMMON_WORDS, and one for all others: the mean shares over its documents that pass the base rules."""
    n_classes, n_common = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 2
    means = [F.avg(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)] + [F.avg(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    found = made.where("not base_failed").groupBy("lang").agg(*means)
    return found.select("lang", F.array(*[f"c{i}" for i in range(n_classes)]).alias("class_reference"), F.filter(F.array(*[f"w{i}" for i in range(n_common)]), lambda x: x.isNotNull()).alias("word_reference"))


def _verdicts(made: DataFrame, found: DataFrame) -> DataFrame:
    rows = made.join(F.broadcast(found), "lang", "left")  # of as many rows as COMMON_WORDS has languages, and one more
    rows = rows.withColumn("class_distance", F.when((F.col("word_chars") >= LEAST_CHARS) & F.col("class_reference").isNotNull(), _js_distance("classes", "class_reference")))
    rows = rows.withColumn("word_distance", F.when((F.col("n_words") >= LEAST_JUDGED_WORDS) & (F.size("common") > 2) & F.col("word_reference").isNotNull(), _js_distance("common", "word_reference")))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The contract's columns, class_distance and word_distance of every row, and kept.

    A language's references are the mean shares of each character class, and of each common word, over all its documents
    that pass the base rules. A document is rejected by the base rules, or because its histogram is further from its
    language's reference than the limit, if it has enough characters (or words) to be judged; a distance is null where
    it has not, where the language has no common words listed, or no reference. Null texts are empty; documents of null
    and unlisted languages share a reference of their own. Repeated rows give repeated rows; other columns are dropped;
    an empty table gives no rows.
    """
    made = cut(_shares(features(_own(docs, id_col, text_col, lang_col).drop("_row")).drop("text")))
    return _verdicts(made, references(made)).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def only_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that judged() keeps, as they are. They are written once with their histograms, so that no text is shuffled."""
    made = cut(_shares(features(_own(docs, id_col, text_col, lang_col))).drop("text"))
    return _verdicts(made, references(made)).where("kept").select("_row.*")
