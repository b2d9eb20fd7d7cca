"""Queries over operators that SQL has no syntax for: searches, joins by order, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import variants
from millrace.operators import inequality, intervals, neighbors, sequences, series, sketches
from millrace.operators.quantiles import exact_percentiles
from millrace.sources import segments
from millrace.sources.tables import table
from millrace.storage import materialize, scratch_path
from millrace.streaming import timers
from millrace.streaming.joins import join_within
from millrace.streaming.upserts import UpsertTable


def vector_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most similar to each of those whose id 20 divides, among all, by exact search."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbors.search(vectors.where("vec_id % 20 = 0"), neighbors.build_index(vectors)).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "similarity")


def vector_neighbors_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an inverted-file index, which finds nine in ten of them at least."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbors.search(vectors.where("vec_id % 20 = 0"), neighbors.build_index(vectors, -1)).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "similarity")


def later_cheaper_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, how many of all later ones have a lower price."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return inequality.inequality_counts(orders, orders, ("o_orderdate", "<", "o_orderdate"), ("o_totalprice", ">", "o_totalprice")).select("o_orderkey", "n")


def cheaper_orders_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order and a later one of the same customer, at most as dear."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    later = orders.select("o_custkey", F.col("o_orderkey").alias("later_key"), F.col("o_orderdate").alias("later_date"), F.col("o_totalprice").alias("later_price"))
    found = inequality.inequality_join(orders, later, ("o_orderdate", "<", "later_date"), ("o_totalprice", ">=", "later_price"), ["o_custkey"])
    return found.select("o_custkey", "o_orderkey", "later_key")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a span of as many minutes as its value."""
    ends = F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("low"), ends.alias("high"))


def most_open_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most spans of events that are open at one time, by type and hour."""
    return intervals.most_open(_spans(spark, sf_dir), "low", "high", "hour", ["event_type"]).select("event_type", "period", "most_open")


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the spans of each user's events cover."""
    return intervals.merged(_spans(spark, sf_dir), "low", "high", ["user_id"])


def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a click and a purchase of a user whose spans overlap."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    spans = _spans(spark, sf_dir).select("event_id", "user_id", "event_type", seconds("low").alias("low"), seconds("high").alias("high"))
    clicks = spans.where("event_type = 'click'").drop("event_type")
    purchases = spans.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer_id"), F.col("low").alias("from"), F.col("high").alias("to"))
    return intervals.overlapping(clicks, purchases, "low", "high", "from", "to", 3600.0, ("user_id", "buyer_id")).select("event_id", "purchase_id")


def purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's purchases within an hour of it, or with none: the batch form of a join of two streams."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    purchases = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer_id"), F.col("ts").alias("bought"))
    return join_within(clicks, purchases, ("user_id", "buyer_id"), ("ts", "bought"), 3600).select("event_id", "purchase_id")


def silent_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a user's events that twelve hours of silence end: the batch form of alerts by timers."""
    found = timers.silence_alerts(table(spark, sf_dir, "events"), 12 * 3600)
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")], "n_events", "n_types")


def upserted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type that is no deletion, as a table holds it to which events were applied in three
    batches, newer before older ones, one of them twice."""
    changes = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"), (F.col("event_id") % 7 == 0).alias("deleted"))
    kept = UpsertTable(spark, scratch_path(spark, "upserts"), ["user_id", "event_type"], "event_id", "deleted")
    for batch_id, part in enumerate((2, 0, 1)):
        kept.write(changes.where(F.col("event_id") % 3 == part), batch_id)
        if batch_id == 1:
            kept.compact()
    kept.write(changes.where("event_id % 3 = 0"), 1)
    return kept.read().drop("deleted")


def funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View, then click, then purchase of a user within a day, without an error between."""
    kind = lambda k: F.col("event_type") == k
    steps = [kind("view"), kind("click"), kind("purchase")]
    return sequences.funnel(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", steps, 24 * 3600, kind("error")).select("user_id", "first", "last")


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the prices of all lines, by flag."""
    found = exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])
    return found.select("l_returnflag", "percent", F.round("value", 4).alias("value"))


def hourly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean value of each hour by type of event, with the hours that have none filled from either side."""
    filled = series.gap_filled(table(spark, sf_dir, "events"), ["event_type"], "ts", "value")
    return filled.select("event_type", "at", *[F.round(c, 6).alias(c) for c in ("value", "last_value", "linear")])


def weekly_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each week that begins on a day with events, from sketches of the days, stored once: whether the distinct users, the
    users who both clicked and bought, those who only clicked, and the median value are near the exact ones, which are
    given. Near: 5% of the users of the week, and a rank between 0.45 and 0.55."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    daily = materialize(sketches.sketched(events, ["day", "event_type"], "user_id", "value"), "daily")
    week = F.explode(F.sequence(F.col("day") - F.expr("interval 6 days"), F.col("day"), F.expr("interval 1 day")))
    first_days = F.broadcast(events.select(F.col("day").alias("week")).distinct())
    weekly = materialize(sketches.merged(daily.withColumn("week", week).join(first_days, "week"), ["week", "event_type"]), "weekly")
    whole = sketches.merged(weekly, ["week"]).select("week", sketches.distinct("hll").alias("users_"), sketches.quantile("kll", 0.5).alias("median_"))
    of = lambda kind: weekly.where(F.col("event_type") == kind).select("week", F.col("theta").alias(kind))
    sets = of("click").join(of("purchase"), "week").select("week", sketches.in_both("click", "purchase").alias("both_"), sketches.in_first_only("click", "purchase").alias("only_"))
    estimates = materialize(whole.join(sets, "week"), "estimates")
    rows = events.withColumn("week", week).join(F.broadcast(estimates), "week")
    users = rows.groupBy("week", "users_", "both_", "only_", "user_id").agg(F.max((F.col("event_type") == "click").cast("int")).alias("c"), F.max((F.col("event_type") == "purchase").cast("int")).alias("p"), F.count("*").alias("n"), F.sum((F.col("value") <= F.col("median_")).cast("int")).alias("low"))
    count = lambda c: F.sum(c.cast("long"))
    c, p = F.col("c") == 1, F.col("p") == 1
    exact = users.groupBy("week", "users_", "both_", "only_").agg(F.count("*").alias("users"), count(c & p).alias("both"), count(c & ~p).alias("clicked_only"), (F.sum("low") / F.sum("n")).alias("rank"))
    near = lambda estimate, of: F.abs(F.col(estimate) - F.col(of)) <= 0.05 * F.col("users")
    return exact.select("week", "users", "both", "clicked_only", near("users_", "users").alias("users_near"), near("both_", "both").alias("both_near"), near("only_", "clicked_only").alias("only_near"), F.col("rank").between(0.45, 0.55).alias("median_near"))


def segmented_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and digests of all pages as a log of Arrow segments gives them back, to which they were added in three
    batches, one of them twice."""
    path = scratch_path(spark, "segments")
    pages = table(spark, sf_dir, "pages")
    for batch_id in (0, 1, 1, 2):
        segments.append(pages.where(F.pmod("page_id", F.lit(3)) == batch_id), path, "page_id", batch_id)
    return segments.read(spark, path).select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"), F.md5("html").alias("digest"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their properties as VARIANT, of which five in six are made another type: text, a nested object, a
    fraction, a broken document, null."""
    k = F.regexp_extract("props", "[0-9]+", 0)
    shapes = [F.concat(F.lit('{"k": "'), k, F.lit('"}')), F.concat(F.lit('{"k": {"n": '), k, F.lit(', "tags": ["a", '), k, F.lit("]}}")), F.concat(F.lit('{"k": '), k, F.lit(".5}")), F.concat(F.lit('{"k": '), k), F.lit('{"k": null, "u": true}')]
    form = F.pmod("event_id", F.lit(6))
    text = F.coalesce(*[F.when(form == n + 1, shape) for n, shape in enumerate(shapes)], F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", variants.parsed(text).alias("v"))


def typed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at paths of properties of mixed types, by its kind."""
    v = F.col("v")
    return _mixed(spark, sf_dir).select(
        "event_id",
        variants.kind(variants.at(v, "$.k")).alias("kind"),
        variants.of_kind(v, "$.k", ("integer",), "bigint").alias("whole"),
        variants.of_kind(v, "$.k", ("integer", "number"), "double").alias("number"),
        variants.of_kind(v, "$.k", ("string",), "string").alias("text"),
        variants.of_kind(v, "$.k.tags[1]", ("integer",), "bigint").alias("second_tag"),
        variants.of_kind(v, "$.u", ("boolean",), "boolean").alias("u"),
    )


def property_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each kind stand at each path of properties of mixed types, by type of event."""
    return variants.path_counts(_mixed(spark, sf_dir), "v", ["event_type"])


def property_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged schema of each type of event's properties of mixed types."""
    return _mixed(spark, sf_dir).groupBy("event_type").agg(variants.merged_schema(F.col("v")).alias("merged"))


QUERIES = {f.__name__: f for f in (vector_neighbors, vector_neighbors_indexed, later_cheaper_orders, cheaper_orders_of_customer, most_open_spans, merged_spans, overlapping_spans, purchases_after_clicks, silent_users, upserted_events, funnels, price_percentiles, hourly_values, weekly_users, segmented_pages, typed_properties, property_paths, property_schemas)}
_SPANS = "s as (select event_id, user_id, event_type, ts as low, ts + to_minutes(floor(value)::int) as high from events)"
_MIXED = """m as (select event_id, event_type, case when json_valid(s) then s::json end as j from (select event_id, event_type, case event_id % 6 when 1 then '{"k": "' || k || '"}'
  when 2 then '{"k": {"n": ' || k || ', "tags": ["a", ' || k || ']}}' when 3 then '{"k": ' || k || '.5}' when 4 then '{"k": ' || k when 5 then '{"k": null, "u": true}' else props end as s
  from (select *, regexp_extract(props, '[0-9]+') as k from events) x) y)"""
_KIND = "case {} when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' else lower({}) end"
_SOUND = "c as (select * from s where low < high)"
ORACLE_SQL = {
    "vector_neighbors": """select query_id, rank, id, similarity from (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from (
  select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as similarity from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id) x) y where rank <= 10""",
    "later_cheaper_orders": "select a.o_orderkey, count(b.o_orderkey) as n from orders a left join orders b on a.o_orderdate < b.o_orderdate and a.o_totalprice > b.o_totalprice group by a.o_orderkey",
    "cheaper_orders_of_customer": "select a.o_custkey, a.o_orderkey, b.o_orderkey as later_key from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderdate < b.o_orderdate and a.o_totalprice >= b.o_totalprice",
    "most_open_spans": f"""with {_SPANS}, {_SOUND},
m as (select event_type, unnest(generate_series(date_trunc('hour', min(low))::timestamp, date_trunc('hour', max(high))::timestamp, interval 1 hour)) as t, 0 as d from c group by event_type),
e as (select event_type, t, sum(d) as d from (select event_type, low as t, 1 as d from c union all select event_type, high, -1 from c union all select * from m) x group by event_type, t)
select event_type, date_trunc('hour', t)::timestamp as period, max(n)::bigint as most_open from (select event_type, t, sum(d) over (partition by event_type order by t) as n from e) y group by 1, 2""",
    "merged_spans": f"""with {_SPANS}, {_SOUND},
b as (select *, case when low > max(high) over (partition by user_id order by low, high rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from c),
g as (select *, sum(new) over (partition by user_id order by low, high rows unbounded preceding) as no from b)
select user_id, min(low) as low, max(high) as high from g group by user_id, no""",
    "overlapping_spans": f"with {_SPANS}, {_SOUND} select a.event_id, b.event_id as purchase_id from c a join c b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and a.low < b.high and b.low < a.high",
    "purchases_after_clicks": """select c.event_id, p.event_id as purchase_id from (select * from events where event_type = 'click') c left join (select * from events where event_type = 'purchase') p
  on c.user_id = p.user_id and p.ts between c.ts and c.ts + interval 1 hour""",
    "silent_users": """select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_events, count(distinct event_type) as n_types from (select *, sum(new) over (partition by user_id order by ts) as no from (
  select *, case when ts <= lag(ts) over (partition by user_id order by ts) + interval 12 hours then 0 else 1 end as new from events) x) y group by user_id, no""",
    "upserted_events": """select user_id, event_type, event_id, round(value, 2) as value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from events) x where k = 1 and event_id % 7 <> 0""",
    "funnels": """select c.user_id, arg_max(a.event_id, (a.ts, a.event_id)) as first, c.event_id as last from events c
  join events b on b.user_id = c.user_id and b.event_type = 'click' and (b.ts, b.event_id) < (c.ts, c.event_id)
  join events a on a.user_id = c.user_id and a.event_type = 'view' and (a.ts, a.event_id) < (b.ts, b.event_id) and a.ts + interval 1 day >= c.ts
  where c.event_type = 'purchase' and not exists (select 1 from events e where e.user_id = c.user_id and e.event_type = 'error' and (e.ts, e.event_id) > (a.ts, a.event_id) and (e.ts, e.event_id) < (c.ts, c.event_id))
  group by c.user_id, c.event_id""",
    "price_percentiles": "select l_returnflag, p as percent, round(q, 4) as value from (select l_returnflag, unnest([0.0, 0.1, 0.5, 0.9, 0.99, 1.0]::double[]) as p, unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])) as q from lineitem group by l_returnflag) x",
    "hourly_values": """with m as (select event_type, date_trunc('hour', ts)::timestamp as t, avg(value) as v from events group by 1, 2),
s as (select event_type, unnest(generate_series(min(t), max(t), interval 1 hour)) as t from m group by event_type),
f as (select s.event_type, s.t, m.v, last_value(case when m.v is not null then s.t end ignore nulls) over w as t0, last_value(m.v ignore nulls) over w as v0,
  first_value(case when m.v is not null then s.t end ignore nulls) over x as t1, first_value(m.v ignore nulls) over x as v1
  from s left join m on m.event_type = s.event_type and m.t = s.t
  window w as (partition by s.event_type order by s.t rows between unbounded preceding and current row), x as (partition by s.event_type order by s.t rows between current row and unbounded following))
select event_type, t as at, round(v, 6) as value, round(v0, 6) as last_value, round(coalesce(v, v0 + (v1 - v0) * (epoch(t) - epoch(t0)) / (epoch(t1) - epoch(t0))), 6) as linear from f""",
    "weekly_users": """with d as (select distinct date_trunc('day', ts)::timestamp as week from events),
u as (select week, user_id, max(event_type = 'click') as c, max(event_type = 'purchase') as p from d join events on ts >= week and ts < week + interval 7 days group by week, user_id)
select week, count(*) as users, count(*) filter (c and p) as both, count(*) filter (c and not p) as clicked_only, true as users_near, true as both_near, true as only_near, true as median_near from u group by week""",
    "segmented_pages": "select page_id, url, strlen(html)::bigint as n_bytes, md5(html) as digest from pages",
    "typed_properties": f"""with {_MIXED}, t as (select *, {_KIND.format("json_type(j, '$.k')", "json_type(j, '$.k')")} as kind from m)
select event_id, kind, case when kind = 'integer' then (j->>'$.k')::bigint end as whole, case when kind in ('integer', 'number') then (j->>'$.k')::double end as number,
case when kind = 'string' then j->>'$.k' end as text, (j->>'$.k.tags[1]')::bigint as second_tag, (j->>'$.u')::boolean as u from t""",
    "property_paths": f"""with {_MIXED} select event_type, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') as path, {_KIND.format("t.type", "t.type")} as kind, count(*) as n
from m, json_tree(m.j) t group by 1, 2, 3""",
    "property_schemas": f"""with {_MIXED}, g as (select event_type, json_group_structure(j) as s from m where j is not null group by event_type)
select event_type, 'OBJECT<k: ' || case s->>'$.k' when 'JSON' then 'VARIANT' when 'UBIGINT' then 'BIGINT' when 'VARCHAR' then 'STRING' end || ', u: ' || (s->>'$.u') || '>' as merged from g""",
}
