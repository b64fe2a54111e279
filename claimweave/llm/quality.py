"""Quality rules in DataFrame functions: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs hash into ``buckets``. Two multinomials with add-one smoothing are counted
over all documents: the raw corpus, and the trusted target, by default the documents that pass
strict rules of form. A document's score is the mean log ratio of its n-grams; those at or
above the threshold stay. Both tables follow the number of buckets and not the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import any_names, free, others

BUCKETS, THRESHOLD = 1 << 16, -0.12
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: bound to a lambda's variable, which the optimizer can't copy into its uses."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(hashes: Column) -> Column:
    """Words in 3-word windows that stand at two or more places, all counted, from the words' 64-bit hashes."""
    n = F.size(hashes)

    def covered(at: Column) -> Column:  # ascending starts: each covers up to the next one, 3 at most
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")))["n"]

    def starts(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(ordered, lambda s: F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()))
        return F.sort_array(pairs)

    keys = F.transform(F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(starts(k)))))


def base_counts(docs: DataFrame, text: str = "text", words: str = "_words", hashes: str = "_hashes") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the words and their hashes under the names given."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(NOT_SPACE))
    out = docs.withColumn(words, words_of(value))
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    return out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(value, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(F.col(hashes), repeat_words).cast("long"),
        }
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def pair(hashes: Column, h: Column, i: Column) -> Column:
    """The hash of a word and the next one; null for the last."""
    return h.bitwiseXOR(F.shiftleft(F.get(hashes, i + 1), 1))


def trusted_form(hashes: str = "_hashes") -> Column:
    """Strict rules of form: length, next to no symbols, no repeated lines, many different words, words of usual length."""
    n = F.col("n_words")
    varied = F.size(F.array_distinct(hashes)) * 5 >= n
    return (n >= 50) & (F.col("n_symbols") * 50 <= n) & (F.col("n_dup_lines") == 0) & varied & F.col("word_chars").between(3 * n, 9 * n)


def ratios(counted: DataFrame, trusted: Column, buckets: int = BUCKETS, hashes: str = "_hashes") -> DataFrame:
    """One row with the log ratio of each bucket, in order, as an array."""
    every = let(F.col(hashes), lambda own: F.concat(own, F.transform(own, lambda h, i: pair(own, h, i))))
    rows = counted.select(trusted.alias("t"), every.alias("all")).select("t", F.explode("all").alias("h")).where("h is not null").select("t", F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("t").alias("good"))
    whole = counted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    listed = whole.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")))).alias("x"), F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    log = lambda c, n: F.log((c + F.lit(1.0)) / (n + F.lit(float(buckets))))
    return listed.select(F.transform("x", lambda b: log(b["good"], F.col("g")) - log(b["raw"], F.col("r"))).alias("w"))


@any_names
def quality(docs: DataFrame, text: str = "text", trusted: Column | None = None, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, score (null without a word) and kept.

    trusted: which documents the target is counted over, on columns of docs and base counts.
    A null text counts as empty: no words, base_failed, not kept. Equal rows get equal results;
    ids are not read. A text's words are one array: long texts take memory in proportion.
    Columns of docs named like the new ones, whatever their case, are replaced. An empty table
    gives an empty result.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    rest = others(docs, new)
    words, hashes, weights = free(docs, "_words", "_hashes", "_weights")
    counted = base_counts(docs.select(*rest), text, words, hashes)
    table = ratios(counted, trusted_form(hashes) if trusted is None else trusted, buckets, hashes).scalar()
    n = F.col("n_words")
    weight = lambda h: F.get(F.col(weights), F.pmod(h, F.lit(buckets)).cast("int"))
    each = let(F.col(hashes), lambda own: F.transform(own, lambda h, i: weight(h) + F.coalesce(weight(pair(own, h, i)), F.lit(0.0))))
    scored = counted.withColumn(weights, table).withColumn("score", F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / (2 * n - 1)))
    kept = ~F.col("base_failed") & (F.coalesce("score", F.lit(float("-inf"))) >= threshold)
    return scored.withColumn("kept", kept).select(*rest, *new[:6], "kept", "score")
