"""Quality rules: base statistics, then a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import cut, table, where_computed, words

#: Buckets of the hashed n-grams; also the length of the weight table, which is all that is sent around.
BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is fitted on at most (those with the smallest hash of their id).
TRUSTED_ROWS = 20_000
#: Added to observed and to expected counts, so that rare buckets weigh little.
SMOOTHING = 4.0
#: Documents whose mean log-likelihood ratio (nats per n-gram) is below this are rejected.
THRESHOLD = -0.17
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def _next(h, step: int):
    """Hashes of windows twice as long: each hash joined with the one step places on; null past the end."""
    return F.transform(h, lambda x, i: F.when(F.get(h, i + step).isNotNull(), F.xxhash64(x, F.get(h, i + step))))


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _words, _h1 (word hashes) and _h2 (hashes of word pairs, null at the last word)."""
    return (
        docs.withColumn("_words", words(F.col(text_col)))
        .withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_h2", _next(F.col("_h1"), 1))
    )


def _grams() -> Column:
    return F.concat("_h1", F.slice("_h2", 1, F.greatest(F.size("_h2") - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, id_col: str, limit: int = TRUSTED_ROWS) -> DataFrame:
    """At most limit ids whose every label says quality 1 and toxic 0: a bounded, repeatable sample."""
    return (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 AND t = 0")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
        .select("_id")
    )


def ratio_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A column with the weights of all buckets in order, an array literal: ln((target + s) / (expected from the raw corpus + s)).

    The raw multinomial counts every n-gram of every document, the target those of the trusted documents. Without
    trusted documents all weights are 0.
    """
    trusted = F.broadcast(trusted_ids(labels, id_col).withColumn("_good", F.lit(1)))
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(trusted, "_id", "left")
    counts = cut(
        _hashed(flagged, text_col)
        .select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode(_grams()).alias("h"))
        .groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket"))
        .agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    )
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    share = total["target"] / max(total["raw"], 1)
    weight = F.log((F.col("target") + SMOOTHING) / (F.col("raw") * F.lit(float(share)) + SMOOTHING))
    found = dict(counts.select("bucket", F.round(weight, 5)).collect())  # BUCKETS rows at most
    return F.split(F.lit(",".join(f"{found.get(k, 0.0):g}" for k in range(BUCKETS))), ",").cast("array<double>")  # folded once


def _repeated_words(n: int) -> list[tuple[str, Column]]:
    """Columns, one after another, that end in _repeat: the words inside n-word windows found twice or more. n: a power of 2."""
    steps, width = [], 2
    while width < n:
        steps.append((f"_h{2 * width}", _next(F.col(f"_h{width}"), width)))
        width *= 2
    top = f"_h{n}"
    pairs = F.transform(F.col(top), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return [
        *steps,
        ("_win", F.filter(top, lambda x: x.isNotNull())),
        ("_twice", F.size(F.array_distinct("_win")) < F.size("_win")),
        ("_sorted", F.when(F.col("_twice"), F.sort_array(F.filter(pairs, lambda p: p["h"].isNotNull())))),
        ("_same", F.filter(F.col("_sorted"), lambda p, k: (k > 0) & (p["h"] == F.get(F.col("_sorted"), F.greatest(k - 1, F.lit(0)))["h"]) | F.coalesce(p["h"] == F.get(F.col("_sorted"), k + 1)["h"], F.lit(False)))),
        ("_at", F.sort_array(F.transform("_same", lambda p: p["i"]))),
        ("_repeat", F.coalesce(F.aggregate(F.transform(F.col("_at"), lambda p, k: F.least(F.lit(n), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(n)))), F.lit(0), lambda a, x: a + x), F.lit(0))),
    ]


def quality_scores(docs: DataFrame, weights: Column, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    llr is the mean weight of a document's hashed words and word pairs: the log-likelihood ratio of the two
    multinomials over the number of n-grams (0 for a document without words). kept: neither base_failed nor
    llr < threshold, so equal texts always get equal verdicts. A null text counts as empty; rows with null ids or
    repeated ids are each judged; columns of docs that have the name of a result are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.translate(s, WHITE, "") != "")
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    row = F.struct(*[c for c in docs.columns if c not in added]).alias("_row")  # out of the way of the names below
    out = _hashed(docs.select(row, text.alias("_t"), lines.alias("_lines")), "_t")
    out = out.withColumn("_grams", _grams())
    out = out.withColumn("llr", F.aggregate("_grams", F.lit(0.0), lambda a, h: a + F.get(weights, F.pmod(h, F.lit(BUCKETS)).cast("int"))) / F.greatest(F.size("_grams"), F.lit(1)))
    for name, column in _repeated_words(REPEAT_WINDOW):
        out = out.withColumn(name, column)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_t", WHITE, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.col("_repeat").cast("long"),
    }).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select("_row.*", *added)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs.select("doc_id", "text"), ratio_weights(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    scored = quality_scores(rows, ratio_weights(docs, table(spark, sf_dir, "labels")))
    return where_computed(scored, "kept").select("_doc.*")
