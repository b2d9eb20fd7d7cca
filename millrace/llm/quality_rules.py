"""Quality rules: counts of a text's words, lines and repeats, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed one- and two-word n-grams are counted over the whole corpus: one of all documents, one
of the trusted ones. A document's score is its mean log ratio of the two per n-gram; it is kept when the base rules
hold and the score reaches a fixed threshold, so the same corpus always gives the same verdicts.

The main path is DataFrame operations only. Counting shuffles one row per bucket and task; scoring is a projection, so
no text is ever shuffled. What reaches the driver is one row per bucket, `buckets` at most.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, HOT_ROWS, extras_apart, left_join_unique, materialize, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 15
#: A kept document's mean log ratio per n-gram, at least.
THRESHOLD = -0.06
#: n-grams per bucket that the trusted counts get in the corpus's own proportions: where few are known, ratios go to 0
#: and documents are left alone.
SMOOTHING = 16.0
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Repeated windows of a text that are looked up one by one.
SHORT_LIST = 16


def _word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _pair_hashes(hashes: Column) -> Column:
    """Of each word and the next one; of the last word and the end of the text."""
    return F.zip_with(hashes, F.slice(hashes, 2, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _bucket(gram_hash: Column, buckets: int) -> Column:
    return F.pmod(gram_hash, F.lit(buckets)).cast("int")


def ngram_log_ratios(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> list[float]:
    """log(trusted probability / corpus probability) of each bucket, counted over all of docs.

    trusted holds the ids (column id_col) of trusted documents; repeats and nulls in it count once and never. Its ids
    are broadcast up to broadcast_rows; beyond that the hashes of documents are shuffled to them, but for those of a
    null id or of one that more than hot_rows documents have. All zero if no trusted
    document has a word. Counts are whole numbers, so the ratios do not depend on the order of summing.
    """
    ids = materialize(trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(1)), "trusted")
    hashed = docs.select(F.col(id_col).alias("_id"), _word_hashes(words(F.col(text_col))).alias("_h"))
    counts = (
        left_join_unique(hashed, ids, "_id", broadcast_rows, hot_rows)
        .select("_trusted", F.explode(F.concat("_h", _pair_hashes(F.col("_h")))).alias("_g"))
        .select("_trusted", _bucket(F.col("_g"), buckets).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count("_trusted").alias("n_trusted"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.n, r.n_trusted
    if not sum(target):
        return [0.0] * buckets
    added, all_raw, all_target = smoothing * buckets, sum(raw), sum(target)
    ratio = lambda r, t: (t * all_raw / r + added) / (all_target + added)
    return [round(math.log(ratio(r, t)), 5) if r else 0.0 for r, t in zip(raw, target, strict=True)]


@extras_apart("text_col")
def quality_rules(
    docs: DataFrame,
    log_ratios: list[float],
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept to each row of docs.

    A null text counts as empty: no words, llr 0, base_failed. Repeated rows are each judged on their own, as every
    column depends on the row's own text only. Other columns pass through; one with the name of a result gives way to
    the result. An empty table gives an empty result.

    n_repeat_words compares three-word windows by 64-bit hashes.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    passed = [c for c in docs.columns if c.lower() not in results]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))
    base = docs.select(*passed, lines.alias("_lines"), words(F.col(text_col)).alias("_words"), symbols.cast("long").alias("n_symbols"))

    found, n = F.col("_words"), F.size("_h")
    base = base.select(
        *passed,
        "n_symbols",
        F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _word_hashes(found).alias("_h"),
    )
    base = base.withColumns({"n_words": n.cast("long"), "_pairs": _pair_hashes(F.col("_h"))})
    # The last two would reach beyond the text.
    threes = F.zip_with("_pairs", F.slice("_h", 3, n), lambda a, b: F.xxhash64(a, b))
    base = base.withColumns({"_g": F.concat("_h", "_pairs"), "_w": F.slice(threes, 1, F.greatest(F.lit(0), n - 2))}).drop("_pairs", "_h")
    # Windows found again. Most texts have none, and few have many.
    ordered = F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array("_w")).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_o", ordered)
    again = F.zip_with("_o", F.slice("_o", 2, F.size("_o")), lambda a, b: F.when(a == b, a))
    base = base.withColumn("_again", F.array_distinct(F.array_compact(again))).drop("_o")
    # Where they begin: looked up in a short list, or else by sorting all windows with their places.
    looked_up = F.filter(F.transform("_w", lambda x, i: F.when(F.array_contains("_again", x), i)), lambda i: i.isNotNull())
    by_window = F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    base = base.withColumn("_s", F.when(F.size("_again") > SHORT_LIST, by_window))
    s = F.col("_s")
    same = lambda x, i: F.get(s, i).getField("h") == x.getField("h")
    kept = F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    none = F.array().cast("array<int>")
    places = F.when(F.size("_again") == 0, none).when(F.size("_again") <= SHORT_LIST, looked_up).otherwise(F.sort_array(F.transform(kept, lambda x: x.getField("i"))))
    base = base.withColumn("_p", places).drop("_s", "_w", "_again")
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    table = F.from_json(F.lit(json.dumps(log_ratios)), "array<double>")
    total = F.aggregate("_g", F.lit(0.0), lambda a, g: a + F.get(table, _bucket(g, len(log_ratios))))
    llr = F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(F.lit(0.0))
    base = base.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    base = base.withColumns({"base_failed": failed, "llr": llr})
    return base.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(*passed, *results)
