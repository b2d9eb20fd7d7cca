"""Relational queries over the star-schema tables."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import udfs
from millrace.functions.vectors import dot
from millrace.operators import joins
from millrace.operators.sessions import sessionize
from millrace.sources.tables import table
from millrace.streaming import windows


def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation within one region and date range, customer and supplier of the same nation."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    nations = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        t("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "n_name")
    )


def _sql(text: str):
    """A query from Spark SQL over views of the tables it names in braces."""
    names = sorted({n for _, n, _, _ in Formatter().parse(text) if n})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    return run


def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error event, the value of the user's last purchase so far."""
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    daily = lambda ts: F.date_trunc("day", ts)
    return joins.asof_join(errors, purchases, ["user_id"], "ts", ["last_value"], cell=daily).select("event_id", "last_value")


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by bands of prices of very different widths, which overlap: a range join."""
    bands = spark.createDataFrame([*[(k, 25_000.0 * k, 25_000.0 * (k + 1)) for k in range(20)], (20, 0.0, 1e9), (21, 400_000.0, float("inf"))], "band int, low double, high double")
    return joins.range_join(table(spark, sf_dir, "orders"), bands, "o_totalprice", "low", "high", 25_000.0).groupBy("band").agg(F.count("*").alias("n"))


def theta_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation, the customers anywhere with a balance above 400 times its number: a join by an inequality only."""
    nations = table(spark, sf_dir, "nation")
    return joins.theta_join(table(spark, sf_dir, "customer"), nations, F.col("c_acctbal") > 400 * F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per user with gaps of up to six hours."""
    found = sessionize(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)
    return found.groupBy("user_id").agg(F.max("session_no").cast("long").alias("n_sessions"), F.count("*").alias("n_events"))


def similarity_to_vector_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product of every vector with the one of id 0; no rows without it."""
    v = table(spark, sf_dir, "embeddings")
    query = v.where("vec_id = 0").agg(F.min(F.col("embedding").cast("array<double>")).alias("query")).where("query is not null")
    return v.crossJoin(F.broadcast(query)).select("vec_id", F.round(dot(F.col("embedding"), F.col("query")), 6).alias("similarity"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event type."""
    counted = windows.windowed_counts(table(spark, sf_dir, "events"), windows.tumbling("1 day"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type of two days, every day."""
    counted = windows.windowed_counts(table(spark, sf_dir, "events"), windows.sliding("2 days", "1 day"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each user's events without a gap of six hours."""
    counted = windows.windowed_counts(table(spark, sf_dir, "events"), windows.session("6 hours"), by="user_id")
    return counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 2).alias("total"))


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    return windows.first_of_each(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority, a column for each status."""
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return counted.select("o_orderpriority", *[F.coalesce(f"{s}_n", F.lit(0)).alias(f"{s}_n") for s in "FOP"], *[f"{s}_price" for s in "FOP"])


def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, and whether the approximate ones are within a tenth of them (a standard error of 2%)."""
    # Beside a distinct count, Spark holds and shuffles a sketch for each distinct pair; of the pairs, the sketch is the same.
    pairs = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()
    found = pairs.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"), F.count("l_partkey").alias("exact"))
    return found.select("l_returnflag", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


def median_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median size of each brand's parts, by a user-defined aggregate."""
    return udfs.median_by(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


def name_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per character of each part's name, by a user-defined function."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(udfs.entropy("p_name"), 6).alias("bits"))


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of parts' names by place, by a user-defined table function."""
    return udfs.words_of(table(spark, sf_dir, "part").select("p_name"), F.col("p_name")).groupBy("place", "word").agg(F.count("*").alias("n"))


#: Spark SQL and DuckDB SQL alike; table names in braces for Spark.
SHARED = {
    "pricing_summary": """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
from {lineitem} where l_shipdate <= timestamp '1999-09-02' group by l_returnflag, l_linestatus""",
    "selected_lines": "select l_orderkey, l_linenumber, l_quantity * 2 as twice from {lineitem} where l_quantity between 10 and 12 and l_returnflag in ('A', 'R') and not (l_discount > 0.02 or l_tax is null)",
    "orders_with_returns": "select o_orderpriority, count(*) as n from {orders} where exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_returnflag = 'R') group by o_orderpriority",
    "customers_without_large_orders": "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 250000)",
    # By the rule of nulls, nothing is known not to be in a list with one.
    "not_in_with_nulls": """select 'without' as list, count(*) as n from {nation} where n_nationkey not in (select s_nationkey from {supplier} where s_acctbal > 5000)
union all select 'with' as list, count(*) as n from {nation} where n_nationkey not in (select nullif(s_nationkey, 0) from {supplier} where s_acctbal > 5000 or s_suppkey < 10 union all select null)""",
    "above_average_balance": "select c_custkey from {customer} c where c_acctbal > (select avg(c_acctbal) from {customer} d where d.c_nationkey = c.c_nationkey)",
    "lateral_orders": """select c_custkey, o_orderkey, o_totalprice from {customer} c, lateral
(select o_orderkey, o_totalprice from {orders} o where o.o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 2) x""",
    "full_join_keys": "select s_suppkey, c_custkey from {supplier} full join {customer} on s_suppkey = c_custkey and s_nationkey = c_nationkey",
    "top_parts_per_supplier": """select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(rn as bigint) as rn from (
select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rn from {lineitem}) x where rn <= 3""",
    "largest_orders": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 100",
    "sorted_customers": "select c_custkey, c_name, c_acctbal from {customer} order by c_acctbal desc nulls last, c_custkey",
    "running_order_totals": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as so_far from {orders}",
    "order_ranks": """select o_orderkey, cast(rank() over w as bigint) as r, cast(dense_rank() over w as bigint) as d, cast(ntile(4) over v as bigint) as quarter, round(percent_rank() over w, 6) as p, round(cume_dist() over w, 6) as c,
lag(o_totalprice, 1) over v as before, lead(o_totalprice, 2) over v as after, first_value(o_orderkey) over v as first
from {orders} window w as (partition by o_custkey order by o_orderpriority), v as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "ninety_day_totals": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate range between interval '90' day preceding and current row), 2) as total from {orders}",
    "rollup_orders": "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus) + grouping(o_orderpriority) as bigint) as g from {orders} group by rollup (o_orderstatus, o_orderpriority)",
    "grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "cube_lines": "select l_returnflag, l_linestatus, count(distinct l_suppkey) as suppliers, count(*) as n from {lineitem} group by cube (l_returnflag, l_linestatus)",
    "large_groups": "select o_custkey, count(*) as n from {orders} group by o_custkey having count(*) > 12",
    "customers_or_suppliers": "select c_nationkey as k from {customer} intersect select s_nationkey from {supplier}",
    "nations_without_rich_suppliers": "select n_nationkey as k from {nation} except select s_nationkey from {supplier} where s_acctbal > 5000",
    "all_nations": "select c_nationkey as k, 'c' as of from {customer} union select s_nationkey, 's' from {supplier}",
    "more_customers_than_orders": "select c_nationkey as k from {customer} except all select cast(o_orderkey % 25 as int) from {orders} where o_orderkey < 50",
    "nations_in_both": "select c_nationkey as k from {customer} intersect all select s_nationkey from {supplier}",
    "recursive_chain": """with recursive chain(k, depth) as (select cast(n_nationkey as bigint), 0 from {nation} union all select 3 * k + 1, depth + 1 from chain where 3 * k + 1 < 2000)
select depth, count(*) as n, sum(p_retailprice) as price from chain join {part} on p_partkey = k group by depth""",
    "balance_statistics": "select c_mktsegment, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as sd, round(median(c_acctbal), 4) as med, min(c_acctbal) as low, max(c_acctbal) as high from {customer} group by c_mktsegment",
    "outer_join_counts": "select n_name, count(s_suppkey) as suppliers from {nation} left join {supplier} on s_nationkey = n_nationkey group by n_name",
    "name_functions": "select p_partkey, upper(p_name) as u, replace(p_name, ' ', '-') as r, cast(length(p_name) as bigint) as n, substring(p_brand, 2, 3) as b, coalesce(nullif(p_type, p_brand), '') as t from {part}",
    "math_functions": "select c_custkey, abs(c_acctbal) as a, cast(floor(c_acctbal / 7) as bigint) as f, round(sqrt(abs(c_acctbal)), 6) as s, round(ln(abs(c_acctbal) + 1), 6) as l, cast(sign(c_acctbal) as int) as g, greatest(c_acctbal, 0.0) as m, mod(c_custkey, 7) as r, power(2.0, c_nationkey) as p from {customer}",
    "case_buckets": "select case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size, count(*) as n, round(sum(p_retailprice), 2) as price from {part} group by 1",
}

#: Spark SQL and DuckDB SQL where they differ.
PAIRS = {
    "event_properties": (
        """select event_id, cast(get_json_object(props, '$.k') as int) as k, from_json(props, 'k int').k + 1 as next, to_json(named_struct('id', event_id)) as j from {events}""",
        """select event_id, cast(props ->> '$.k' as int) as k, cast(json_extract_string(props, '$.k') as int) + 1 as next, cast(to_json({{'id': event_id}}) as varchar) as j from {events}""",
    ),
    "text_patterns": (
        """select p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) as number, regexp_replace(p_name, '[aeiou]', '*') as masked, p_name rlike '^b' as b,
split(p_name, ' ')[0] as first, cast(size(split(p_name, ' ')) as bigint) as words, concat_ws('/', p_type, p_brand) as path, lpad(p_type, 9, '.') as padded, instr(p_name, 'e') as e from {part}""",
        """select p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) as number, regexp_replace(p_name, '[aeiou]', '*', 'g') as masked, regexp_matches(p_name, '^b') as b,
string_split(p_name, ' ')[1] as first, cast(len(string_split(p_name, ' ')) as bigint) as words, concat_ws('/', p_type, p_brand) as path, lpad(p_type, 9, '.') as padded, cast(instr(p_name, 'e') as int) as e from {part}""",
    ),
    "array_functions": (
        """select s_nationkey, cast(size(a) as bigint) as n, array_join(transform(filter(a, x -> x % 2 = 0), x -> cast(x * 10 as string)), ',') as even, array_contains(a, 7L) as has, array_max(a) as top, cast(aggregate(a, 0L, (s, x) -> s + x) as bigint) as total
from (select s_nationkey, sort_array(collect_set(s_suppkey)) as a from {supplier} group by s_nationkey)""",
        """select s_nationkey, cast(len(a) as bigint) as n, array_to_string(list_transform(list_filter(a, lambda x: x % 2 = 0), lambda x: cast(x * 10 as varchar)), ',') as even, list_contains(a, 7) as has, list_max(a) as top, cast(list_sum(a) as bigint) as total
from (select s_nationkey, list_sort(list(distinct s_suppkey)) as a from {supplier} group by s_nationkey)""",
    ),
    "exploded_words": (
        "select word, count(*) as n from (select explode(split(p_name, ' ')) as word from {part}) group by word",
        "select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from {part}) group by word",
    ),
    "map_functions": (
        """select n_nationkey, m['name'] as name, cast(size(map_keys(m)) as bigint) as keys, m['none'] as none, array_join(array_sort(map_values(m)), '|') as vals
from (select n_nationkey, map('name', n_name, 'region', cast(n_regionkey as string)) as m from {nation})""",
        """select n_nationkey, m['name'] as name, cast(len(map_keys(m)) as bigint) as keys, m['none'] as none, array_to_string(list_sort(map_values(m)), '|') as vals
from (select n_nationkey, map {{'name': n_name, 'region': cast(n_regionkey as varchar)}} as m from {nation})""",
    ),
    "date_functions": (
        """select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, cast(date_trunc('month', o_orderdate) as timestamp_ntz) as m, cast(weekday(o_orderdate) as bigint) as monday,
cast(datediff(o_orderdate, date'1995-01-01') as bigint) as days, date_format(o_orderdate, 'yyyy/MM/dd') as text, cast(add_months(o_orderdate, 1) as date) as later, cast(last_day(o_orderdate) as date) as last from {orders}""",
        """select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, date_trunc('month', o_orderdate)::timestamp as m, isodow(o_orderdate) - 1 as monday,
date_diff('day', timestamp '1995-01-01', o_orderdate) as days, strftime(o_orderdate, '%Y/%m/%d') as text, cast(o_orderdate + interval 1 month as date) as later, last_day(o_orderdate) as last from {orders}""",
    ),
}

_FRAMES = (star_revenue, asof_price, price_bands, theta_balances, sessions, similarity_to_vector_0, event_windows, sliding_counts, session_windows, first_events, status_pivot, approximate_distinct, median_sizes, name_entropy, name_words)
QUERIES = {f.__name__: f for f in _FRAMES} | {n: _sql(t) for n, t in SHARED.items()} | {n: _sql(spark) for n, (spark, _) in PAIRS.items()}


def _plain(text: str) -> str:
    return text.format_map({n: n for _, n, _, _ in Formatter().parse(text) if n})


ORACLE_SQL = {
    "star_revenue": """
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'
group by n_name
""",
    "asof_price": """select e.event_id, p.last_value from (select event_id, user_id, ts from events where event_type = 'error') e
asof left join (select user_id, ts, value as last_value from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts""",
    "price_bands": """select band, count(*) as n from (select cast(range as int) as band, 25000 * range as low, 25000 * (range + 1) as high from range(20) union all values (20, 0, 1000000000), (21, 400000, 1000000000)) b
join orders on o_totalprice >= low and o_totalprice < high group by band""",
    "theta_balances": "select n_name, count(*) as n from nation join customer on c_acctbal > 400 * n_nationkey group by n_name",
    "sliding_counts": """select (date_trunc('day', ts) - to_days(k::int))::timestamp as start, event_type, count(*) as n, round(sum(value), 2) as total from events, range(2) r(k) group by 1, 2""",
    "session_windows": """select user_id, min(ts) as start, count(*) as n, round(sum(value), 2) as total from (select *, sum(new) over (partition by user_id order by ts) as no from
(select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hours then 1 else 0 end as new from events window w as (partition by user_id order by ts)) x) y group by user_id, no""",
    "first_events": "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "status_pivot": "select o_orderpriority, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') as {s}_n, round(sum(o_totalprice) filter (o_orderstatus = '{s}'), 2) as {s}_price" for s in "FOP") + " from orders group by o_orderpriority",
    "approximate_distinct": "select l_returnflag, count(distinct l_partkey) as exact, true as near from lineitem group by l_returnflag",
    "median_sizes": "select p_brand, median(p_size::double) as median from part group by p_brand",
    "name_entropy": """select p_partkey, round(-sum(n / total * log2(n / total)), 6) as bits from (select p_partkey, count(*) as n, sum(count(*)) over (partition by p_partkey) as total
from (select p_partkey, unnest(string_split(p_name, '')) as c from part) x group by p_partkey, c) y group by p_partkey""",
    "name_words": "select place, word, count(*) as n from (select unnest(range(len(w)))::int as place, unnest(w) as word from (select string_split(p_name, ' ') as w from part)) x group by place, word",
    "sessions": """select user_id, cast(sum(new) as bigint) as n_sessions, count(*) as n_events from (select user_id, case when lag(ts) over w is null or ts > lag(ts) over w + interval 6 hours then 1 else 0 end as new
from events window w as (partition by user_id order by ts)) x group by user_id""",
    "similarity_to_vector_0": "select v.vec_id, round(list_dot_product(v.embedding::double[], q.embedding::double[]), 6) as similarity from embeddings v, (select embedding from embeddings where vec_id = 0) q",
    "event_windows": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
} | {n: _plain(t) for n, t in [*SHARED.items(), *[(n, duck) for n, (_, duck) in PAIRS.items()]]}
