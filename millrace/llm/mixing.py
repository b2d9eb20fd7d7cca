"""Mixing sources to target weights: whole copies first, the rest by Pareto order sampling (Rosen, 1997).

A source that is to give e = target / size words per word gives floor(e) certain copies of every document. The other
e - floor(e) come from a Pareto sample. A source's documents fall into classes of about equal size, and each class has a
sample of a fixed number of documents: from the largest class down, the number whose words come nearest to the class's
share and what the classes before left over or overdrew. Within a class inclusion is unequal, by size: with mean
inclusion m, a document has p = m + m (1 - m) (size / mean size - 1), so the probabilities add up to the sample's
number and lie between 0 and 1, as no document has twice its class's mean. Ranks are u / (1 - u) divided by
p / (1 - p), u a hash of the id and the text, and the documents of least rank enter.

The main path is DataFrame operations only. A class's ranks are cut into slices of some SLICE_ROWS rows, whatever the
class's size; only the slice in which its sample ends is put in order. What is joined to the documents is one row per
source and class: the rank at which the sample ends. So a document's text need not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, extras_apart, join_unique, materialize, running_sums, words

#: Weights of the sources in code point order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST_COPIES = 3
#: Rows of a class in a slice, about.
SLICE_ROWS = 1000
SEED = "millrace-mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. Where a share is
    above `most` times the size it is cut to that, and the excess goes to the others by weight. The sources that are
    cut are those of the smallest size per weight: with k of them cut, the others get an equal level per weight; the
    right k is the least whose level is not above the next one's bound. Sources are numbered and summed by ranges, so
    there may be as many as hosts.
    """
    by_name = [F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")]
    numbered = running_sums(sizes.select("source", "source_size"), by_name, {"_k": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_k"), F.lit(len(weights))) + 1).cast("int"))
    ranked = numbered.select("source", "source_size", weight.cast("long").alias("weight"))
    ranked = running_sums(ranked, [F.col("source_size") / F.col("weight"), *by_name], {"_size": F.col("source_size"), "_weight": F.col("weight"), "_k": F.lit(1)})
    ranked = materialize(ranked, "levels")
    size, w = F.col("source_size"), F.col("weight")
    all_size, all_weight = (x or 0 for x in ranked.agg(F.sum(size), F.sum(w)).first())
    level = ranked.withColumns({"left": F.lit(all_size) - most * F.col("_size"), "left_weight": F.lit(all_weight) - F.col("_weight")})
    # left / left_weight <= most * size / weight, in whole numbers.
    exact = lambda c: c.cast("decimal(18,0)")
    fits = exact(F.col("left")) * exact(w) <= exact(most * size) * exact(F.col("left_weight"))
    first = level.where(fits).agg(F.min(F.struct("_k", "left", "left_weight")).alias("f")).first()["f"] or (0, 0, 1)
    shared = F.lit(float(first[1])) * w / F.lit(first[2])
    return level.select("source", "source_size", F.when(F.col("_k") < first[0], (most * size).cast("double")).otherwise(shared).alias("target"))


def _size_class(size: Column) -> Column:
    """Classes within an octave of sizes in four equal parts; class 0 is for size 0."""
    octave = F.length(F.bin(size)) - 1
    return F.when(size > 0, 4 * octave + F.call_function("shiftright", size * 4, octave) - 3).otherwise(0).cast("int")


def _stratum(source: Column, size_class: Column) -> Column:
    return F.concat_ws("|", size_class.cast("string"), F.when(source.isNull(), "null").otherwise("source"), source)


def _uniform(digest: Column) -> Column:
    """A number above 0 and below 1, a multiple of 2^-53: 13 hexadecimal digits of a digest and a half."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _shares(strata: DataFrame, plan: DataFrame) -> DataFrame:
    """strata (source, class, n, words, squares) with their source's columns and `draws`, the documents to sample.

    A source's classes, some 250 at most, are gone through from the largest down: each draws the number of documents
    whose expected words are nearest to what is wanted, and hands on the rest.
    """
    gathered = strata.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "n", "words", "squares")), asc=False).alias("c"))
    planned = gathered.join(plan.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    zero = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<class:int,n:bigint,words:bigint,draws:bigint>>").alias("done"))

    def step(acc: Column, c: Column) -> Column:
        mean = c["words"] / c["n"]
        want = F.col("part") * c["words"] + acc["carry"]
        draws = F.when(c["words"] == 0, 0).otherwise(F.least(c["n"], F.greatest(F.lit(0), F.floor(want / mean + 0.5)))).cast("bigint")
        m = draws / c["n"]
        expected = F.when(c["words"] == 0, 0.0).otherwise(draws * mean + m * (1 - m) * (c["squares"] / mean - c["words"]))
        return F.struct((want - expected).alias("carry"), F.concat(acc["done"], F.array(F.struct(c["class"].alias("class"), c["n"].alias("n"), c["words"].alias("words"), draws.alias("draws")))).alias("done"))

    return planned.select("source", "source_size", "target", "whole", F.explode(F.aggregate("c", zero, step)["done"]).alias("c")).select("source", "source_size", "target", "whole", "c.*")


def _rank(size: Column, u: Column) -> Column:
    """The odds ratio q of a document of a class, as q / (1 + q), which keeps the order."""
    m = F.col("_m")
    p = m + m * (1 - m) * (size / F.col("_mean") - 1)
    return (u * (1 - p)) / (u * (1 - p) + (1 - u) * p)


def sampling_plan(sized: DataFrame, weights: tuple[int, ...], most: int, slice_rows: int = SLICE_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per stratum (source and class) of sized (source _s, size, digest _g; a written table): source_size and
    target, whole copies, mean inclusion _m and mean size _mean, and where the sample ends: _cut, the rank and digest
    of its last document; _take of the _equal rows that have both of these are in it."""
    per_class = sized.groupBy(F.col("_s").alias("source"), _size_class(F.col("size")).alias("class"))
    squares = F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("double")
    strata = materialize(per_class.agg(F.count("*").alias("n"), F.sum("size").alias("words"), squares.alias("squares")), "strata")
    plan = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumns({"whole": F.floor(e), "part": e - F.floor(e)})
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    shares = _shares(strata, plan).select(_stratum(F.col("source"), F.col("class")).alias("_stratum"), "source_size", "target", "whole", "draws", (F.col("draws") / F.col("n")).alias("_m"), F.when(F.col("words") > 0, F.col("words") / F.col("n")).otherwise(1.0).alias("_mean"), slices.alias("_slices"))
    shares = materialize(shares, "shares")

    drawn = shares.where("_m > 0 and _m < 1").select("_stratum", "draws", "_m", "_mean", "_slices")
    narrow = sized.select(_stratum(F.col("_s"), _size_class(F.col("size"))).alias("_stratum"), "size", "_g")
    ranked = join_unique(narrow, drawn, "_stratum", broadcast_rows).withColumn("_q", _rank(F.col("size"), _uniform(F.col("_g"))))
    # With p = m for all, this is u again, so slices are of about equal size.
    even = F.col("_q") * F.col("_m") / (F.col("_q") * F.col("_m") + (1 - F.col("_q")) * (1 - F.col("_m")))
    ranked = ranked.withColumn("_slice", F.least(F.col("_slices") - 1, F.floor(even * F.col("_slices"))).cast("int"))
    counts = ranked.groupBy("_stratum", "_slice").agg(F.count("*").alias("_n"), F.first("draws").alias("_draws"))
    before = F.sum("_n").over(Window.partitionBy("_stratum").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    ends = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col("_before") < F.col("_draws")) & (F.col("_before") + F.col("_n") >= F.col("_draws")))
    ends = materialize(ends.select("_stratum", F.col("_slice").alias("_end"), "_before"), "ends")
    last = join_unique(materialize(ranked.select("_stratum", "_slice", "_q", "_g", "draws"), "ranked"), ends, "_stratum", broadcast_rows).where("_slice = _end")
    # Rows of one rank and digest are one row, with their number.
    met = last.groupBy("_stratum", "_q", "_g").agg(F.count("*").alias("_equal"), F.first("draws").alias("draws"), F.first("_before").alias("_before"))
    so_far = F.sum("_equal").over(Window.partitionBy("_stratum").orderBy("_q", "_g").rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("_before", F.col("_before") + F.coalesce(so_far, F.lit(0))).where((F.col("_before") < F.col("draws")) & (F.col("_before") + F.col("_equal") >= F.col("draws")))
    cuts = met.select("_stratum", F.struct("_q", "_g").alias("_cut"), (F.col("draws") - F.col("_before")).alias("_take"), "_equal")
    return materialize(shares.drop("_slices", "draws").join(cuts, "_stratum", "left"), "plan")


@extras_apart("id_col", "text_col", "source_col")
def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    slice_rows: int = SLICE_ROWS,
    seed: str = SEED,
    broadcast_rows: int = BROADCAST_ROWS,
    keep_text: bool = False,
) -> DataFrame:
    """docs with size (words), source_size, target, copies and taken (copies times size); without its text unless
    keep_text, which reads the documents a second time in place of a shuffle of their texts.

    Each class's sample has its fixed number of documents; a source's words come near its target: what the smallest
    class leaves over, and the chance in each class within which sizes differ by a quarter at most. Nulls: a null
    source is a source of its own, a null text has no words, a null id is hashed as an empty one. Rows of one id have
    their own chance by text; equal rows are interchangeable, and of those at a sample's end as many enter as it has
    room for. Documents without words are never copied beyond the whole copies. The result depends on the ids,
    sources and texts only, not on partitions, so reruns agree. Other columns pass through; ones named as a result
    give way. An empty table gives an empty result.
    """
    results = ["size", "source_size", "target", "copies", "taken"]
    rest = [c for c in docs.columns if (keep_text or c != text_col) and c.lower() not in results]
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    measured = docs.select(*rest, F.size(words(F.col(text_col))).cast("long").alias("size"), F.col(source_col).alias("_s"), digest.alias("_g"))
    sized = materialize(measured.select(*[c for c in measured.columns if c != text_col and c != "_extra"] if keep_text else measured.columns), "sizes")
    plan = sampling_plan(sized, weights, most, slice_rows, broadcast_rows)
    placed = (measured if keep_text else sized).withColumn("_stratum", _stratum(F.col("_s"), _size_class(F.col("size"))))
    ranked = join_unique(placed, plan, "_stratum", broadcast_rows).withColumn("_at", F.struct(_rank(F.col("size"), _uniform(F.col("_g"))).alias("_q"), F.col("_g").alias("_g")))
    # Without a cut, the sample has none or all.
    taken = F.when(F.col("_cut").isNull(), F.col("_m") > 0).otherwise(F.col("_at") <= F.col("_cut"))
    ranked = ranked.withColumn("_in", taken)
    crowded = F.coalesce((F.col("_at") == F.col("_cut")) & (F.col("_take") < F.col("_equal")), F.lit(False))
    if not plan.where("_take < _equal").isEmpty():
        numbered = running_sums(ranked.where(crowded), [F.col("_g")], {"_k": F.lit(1)}, by=("_stratum",))
        ranked = ranked.where(~crowded).unionByName(numbered.withColumn("_in", F.col("_k") < F.col("_take")).drop("_k"))
    copies = F.col("whole") + F.col("_in").cast("long")
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*rest, *results)
