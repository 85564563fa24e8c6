"""Quality rules in DataFrame functions alone: hard rules, then hashed n-gram likelihood ratios.

Words and word pairs are hashed to buckets. One multinomial over the buckets is
counted from trusted texts, one from the whole corpus; a document's score is the
mean, over its n-grams, of the log of their ratio. Documents below a fixed
score are not kept. The two count tables have a fixed number of buckets, so the weights
are small whatever the corpus, and looking them up is a broadcast join of proven size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import keep, text_of, without

BUCKETS = 1 << 16
#: Occurrences that speak for a ratio of one in every bucket, so that what is merely rare says little.
SMOOTHING = 3.0
THRESHOLD = -0.16
MIN_WORDS = 50
#: Percent of words that may stand in repeated windows.
MAX_REPEATED = 50

_SYMBOLS = "#*$%&|<>"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is then computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of three that occurs twice or more."""

    def windows(h: Column) -> Column:
        n = F.size(h) - 2
        return F.zip_with(
            F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b)),
            F.slice(h, 3, n),
            lambda a, b: F.xxhash64(a, b),
        )

    def starts(found: Column) -> Column:
        """Places of windows that have an equal, ascending; equal ones are neighbours once sorted."""

        def pairs(s: Column) -> Column:
            n = F.size(s) - 1
            both = F.zip_with(
                F.slice(s, 1, n),
                F.slice(s, 2, n),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            )
            return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda p: p.isNotNull()))))

        placed = F.transform(found, lambda w, i: F.struct(w.alias("h"), i.alias("i")))
        return _bound(F.sort_array(placed), pairs)

    def covered(at: Column) -> Column:
        n = F.size(at) - 1
        steps = F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(steps, F.lit(3).cast("long"), lambda total, step: total + step)

    def count(found: Column) -> Column:
        # most texts repeat no window, which a set shows without sorting
        unique = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(unique, F.lit(0).cast("long")).otherwise(_bound(starts(found), covered))

    return F.when(F.size(hashes) < 4, F.lit(0).cast("long")).otherwise(_bound(windows(hashes), count))


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``RULES`` and base_failed; a null text has no words."""
    text = text_of(docs)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = without(docs, *RULES, "base_failed", "__words", "__hashes")
    found = found.select(
        "*",
        _words(text).alias("__words"),
        F.regexp_count(text, F.lit(f"[{_SYMBOLS}]")).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    found = found.select(
        "*",
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
    ).drop("__words")
    found = found.withColumn("n_words", F.size("__hashes").cast("long"))
    found = found.withColumn("n_repeat_words", _repeated_words(F.col("__hashes")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _buckets(hashes: Column) -> Column:
    """Buckets of all words and of all neighbouring pairs."""
    pairs = F.when(
        F.size(hashes) > 1,
        F.zip_with(
            F.slice(hashes, 1, F.size(hashes) - 1), F.slice(hashes, 2, F.size(hashes) - 1), lambda a, b: F.xxhash64(a, b)
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.concat(hashes, pairs)


def _bucket_counts(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    hashes = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    rows = texts.select(F.explode(_bound(hashes, _buckets)).alias("h"))
    return rows.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias(name))


def weights(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """bucket, other, own: log of the bucket's share of trusted texts over its share of all.

    Each occurrence is judged by the others: ``other`` leaves one out of all texts, ``own``, for trusted
    documents, one out of both. Else every rare word would speak against its only text. ``trusted`` holds each id (doc_id) once,
    however many. A bucket that never occurs has no row.
    """
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    # the one exchange of texts, planned alike at any number of trusted ids
    good = texts.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")
    counts = keep(
        _bucket_counts(texts, buckets, "n_all").join(_bucket_counts(good, buckets, "n_good"), "bucket", "left").fillna(0, ["n_good"]),
        "ngram-counts",
    )
    total = counts.agg(F.sum("n_all").alias("a"), F.sum("n_good").alias("g")).first()
    n_all, n_good = total["a"] or 0, total["g"] or 0
    if not n_good:  # nothing is trusted: nothing tells texts apart
        return counts.select("bucket", F.lit(0.0).alias("other"), F.lit(0.0).alias("own"))
    expected = (F.col("n_all") - 1) * F.lit(n_good / n_all) + smoothing
    ratio = lambda good: F.log((F.greatest(good, F.lit(0)) + smoothing) / expected)
    return counts.select("bucket", ratio(F.col("n_good")).alias("other"), ratio(F.col("n_good") - 1).alias("own"))


def trusted_ids(labels: DataFrame, *, label: str = "quality") -> DataFrame:
    """doc_id of all documents that are labelled good, each once."""
    return labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def judge(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts of ``RULES``, base_failed, ngram_score and kept of every row of ``docs``.

    A text without n-grams, a null one too, scores 0; it fails the rules anyway. Rows with the same id, or
    none, are judged each by itself; an empty table gives an empty one. Both scores of a row, as a trusted text and as
    another, are computed without asking which it is; only they meet the trusted ids.
    """
    trusted = keep(trusted_ids(labels), "trusted")
    table = keep(weights(docs, trusted, buckets=buckets), "ngram-weights")
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))
    rows = base_rules(numbered).drop("text")
    carried = ["__row", "doc_id", *RULES, "base_failed"]
    grams = rows.select(*carried, F.explode_outer(_bound(F.col("__hashes"), _buckets)).alias("h"))
    # one row per bucket
    looked_up = grams.withColumn("bucket", F.pmod("h", F.lit(buckets))).join(F.broadcast(table), "bucket", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    scored = looked_up.groupBy(*carried).agg(mean("other"), mean("own")).drop("__row")
    good = trusted.select("doc_id", F.lit(True).alias("good"))
    scored = scored.join(good, "doc_id", "left")
    score = F.when(F.col("good"), F.col("own")).otherwise(F.col("other"))
    scored = scored.select("doc_id", *RULES, "base_failed", score.alias("ngram_score"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ngram_score") >= threshold))
