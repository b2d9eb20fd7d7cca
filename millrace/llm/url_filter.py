"""URL filters as a sort-merge range join of canonical keys with nested prefix rules.

The key of a host and path is the host's labels in reverse, each with a dot, a slash, which no host holds, and the path:
`com.example.www.//en/1`. So no part of a host's key is taken for a path's.
The rules that fit a URL are, for the host and each of its parent domains of as many labels as some rule has, the
rules whose keys are prefixes of that domain's key with the URL's path. A rule's key is an interval of sorted keys, and
intervals of prefixes nest. So rules and URL keys are sorted together and swept: every rule carries the stack of the
rules around it, the last rule before a URL's key is handed on, and the deepest rule on its stack that is a prefix of
the key is the longest that fits.

The main path is DataFrame operations only. Sorting is by ranges, equal keys spread over several, and each range takes
up the last rule of the ranges before it, one row per range: no task holds a hot host, and nothing goes through the
driver but the few numbers of labels and lengths that rules have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, extras_apart, join_unique, materialize

DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_key(host: Column, labels: int) -> Column:
    """The reversed key of the host's last `labels` labels: `com.`, `com.example.`; null for a host of fewer."""
    ends = F.split(F.substring_index(host, ".", -labels), "\\.")
    return F.when(F.size(ends) == labels, F.concat(F.array_join(F.reverse(ends), "."), F.lit(".")))


def _rule_stacks(rules: DataFrame, broadcast_rows: int) -> DataFrame:
    """(key, stack, labels): each rule's key, the rules that are prefixes of it, itself last, as (key, rule, verdict),
    and the labels of its host.

    The stack comes from an equi-join on prefixes; only lengths that some rule has are tried.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    labels = F.reverse(F.split(host, "\\."))
    named = rules.select(F.concat(F.array_join(labels, "."), F.lit("./"), path).alias("key"), F.concat(F.coalesce("host", F.lit("")), path).alias("rule"), F.lower("verdict").alias("verdict"), F.size(labels).alias("labels"))
    # Of rules with equal keys a block goes before an allow.
    once = named.where("verdict in ('allow', 'block')").groupBy("key").agg(F.max(F.struct("verdict", "rule", "labels")).alias("v"))
    keyed = materialize(once.select("key", "v.rule", "v.verdict", "v.labels"), "rules")
    # No more lengths than the longest rule has characters.
    lengths = sorted(r[0] for r in keyed.select(F.length("key")).distinct().collect())
    tried = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("whole"))
    prefixes = keyed.select(F.col("key").alias("whole"), F.col("labels").alias("of")).select("whole", "of", F.explode(F.transform(tried, lambda n: F.substring("whole", F.lit(1), n))).alias("key"))
    each = join_unique(materialize(prefixes, "prefixes"), keyed, "key", broadcast_rows)
    return each.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("key", "rule", "verdict"))).alias("stack"), F.first("of").alias("labels")).withColumnRenamed("whole", "key")


@extras_apart("url_col")
def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with host, path, rule and verdict. rules has the columns host, path and verdict (allow or block).

    A rule fits its host and all subdomains if the URL's path starts with the rule's. Of the rules that fit, the one
    with the longest text (host and path) wins, of equally long ones the one with the longer host, then block. Without
    one, rule is null and verdict is `default`. Rules with another verdict are ignored, null hosts and paths of rules
    are empty, and an empty host fits an empty host only. Null and malformed URLs have an empty host and path.
    Repeated rows are judged each; other columns pass through, and ones named as a result give way. A URL makes one
    key for each number of labels that rules have, so a host of very many labels makes no more than others.
    """
    results = ["host", "path", "rule", "verdict"]
    rest = [c for c in pages.columns if c.lower() not in results]
    read = materialize(pages.select(*rest, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("_row")), "urls")
    stacks = materialize(_rule_stacks(rules, broadcast_rows), "stacks")
    depths = sorted(r[0] for r in stacks.select("labels").distinct().collect())
    keys = F.array_compact(F.array(*[domain_key(F.col("host"), n) for n in depths])).cast("array<string>")
    probes = read.select("_row", F.explode(keys).alias("domain"), "path").select(F.concat("domain", F.lit("/"), "path").alias("key"), "_row")
    kind = stacks.schema["stack"].dataType
    both = stacks.select("key", F.lit(None).cast("bigint").alias("_row"), "stack").unionByName(probes.withColumn("stack", F.lit(None).cast(kind)))
    spread = F.xxhash64("_row")
    ranges = materialize(both.repartitionByRange("key", F.col("_row").isNotNull(), spread).withColumn("_range", F.spark_partition_id()), "ranges")
    # The last rule up to the end of each range, for the next one; one row per range.
    last = ranges.where("_row is null").groupBy("_range").agg(F.max(F.struct("key", "stack"))["stack"].alias("_last"))
    last = ranges.select("_range").distinct().join(last, "_range", "left")
    taken_up = last.select("_range", F.last("_last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    taken_up = materialize(taken_up.where("_before is not null"), "last")
    sweep = Window.partitionBy("_range").orderBy("key", F.col("_row").asc_nulls_first())
    swept = ranges.withColumn("_here", F.last("stack", ignorenulls=True).over(sweep)).where("_row is not null")
    active = swept.join(F.broadcast(taken_up), "_range", "left").select("_row", "key", F.coalesce("_here", "_before").alias("stack"))
    fits = active.select("_row", F.element_at(F.concat(F.array(F.lit(None)), F.filter("stack", lambda r: F.col("key").startswith(r["key"]))), -1).alias("r")).where("r is not null")
    best = fits.groupBy("_row").agg(F.max(F.struct(F.length("r.rule"), F.length(F.substring_index("r.key", "/", 1)), "r.verdict", "r.rule")).alias("best"))
    return read.join(best, "_row", "left").select(*rest, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path) tuples."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
