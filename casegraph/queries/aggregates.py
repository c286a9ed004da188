"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import relational as R
from . import Tables, query


@query("select event_type grp, cast(count(*) as double) as value from events group by 1")
def aggregate_kind(t: Tables) -> DataFrame:
    return R.aggregate_by(t.events, "event_type")


for _name, _sql in (("month", "strftime(o_orderdate, '%Y-%m')"), ("weekday", "strftime(o_orderdate, '%a')"), ("week", "strftime(o_orderdate, '%G-W%V')"), ("day", "strftime(o_orderdate, '%Y-%m-%d')")):

    def _f(t: Tables, name: str = _name) -> DataFrame:
        return R.aggregate_by(t.orders, R.BUCKETS[name](F.col("o_orderdate")), "sum", "o_totalprice")

    _f.__name__ = f"aggregate_{_name}"
    query(f"select {_sql} grp, cast(sum(cast(o_totalprice as decimal(38,4))) as double) as value from orders group by 1")(_f)


@query("select strftime(ts, '%H') grp, cast(count(*) as double) as value from events group by 1")
def aggregate_hour(t: Tables) -> DataFrame:
    return R.aggregate_by(t.events, R.BUCKETS["hour"](F.col("ts")))


@query("select case when s >= 0.7 then 'very high' when s >= 0.4 then 'high' when s >= 0.2 then 'elevated' else 'low' end grp, cast(count(*) as double) as value from (select (c_acctbal + 1000) / 11000 s from customer) group by 1")
def aggregate_band(t: Tables) -> DataFrame:
    return R.aggregate_by(t.customer, K.band((F.col("c_acctbal") + 1000) / 11000))


@query("""select strftime(ts, '%Y-%m-%d') bucket, cast(count(*) filter (event_type = 'click') as bigint) click, cast(count(*) filter (event_type = 'error') as bigint) error, cast(count(*) filter (event_type = 'purchase') as bigint) purchase, cast(count(*) filter (event_type = 'signup') as bigint) signup, cast(count(*) filter (event_type = 'view') as bigint) as view from events group by 1""")
def pivot_histogram(t: Tables) -> DataFrame:
    return R.pivot_counts(t.events, F.date_format("ts", "yyyy-MM-dd"), "event_type", ["click", "error", "purchase", "signup", "view"])


@query("select source, cast(count(*) as bigint) n, cast(sum(n_chars) as bigint) chars from documents group by 1")
def source_totals(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""with b as (select event_type, quantile_cont(value, 0.5) median, quantile_cont(value, 0.9) p90, cast(avg(cast(value as decimal(38,4))) as double) mean, stddev_pop(value) sd from events group by 1)
 select event_type, median, p90, round(mean, 6) mean, round(sd, 6) sd, (select quantile_cont(abs(e.value - b.median), 0.5) from events e where e.event_type = b.event_type) mad from b""")
def percentiles_std_mad(t: Tables) -> DataFrame:
    return R.robust(t.events, ["event_type"], "value").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("select l_suppkey, cast(count(distinct o_custkey) as bigint) customers, cast(count(distinct l_partkey) as bigint) parts from lineitem join orders on o_orderkey = l_orderkey group by 1")
def distinct_counterparties(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("l_partkey").alias("parts"))


@query("""with c as (select user_id, event_type, count(*) n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, event_type) k from c) select user_id, string_agg(event_type||'='||n, ',' order by n desc, event_type) top from r where k <= 3 group by 1""")
def top_n_map(t: Tables) -> DataFrame:
    c = R.top_per_group(t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], [F.desc("n"), F.col("event_type")], 3)
    return c.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("=", "event_type", "n").alias("x")))), lambda s: s["x"]), ",").alias("top"))


@query("""with x as (select 'C'||o_custkey a, 'S'||l_suppkey b, cast(l_extendedprice as decimal(38,4)) m from lineitem join orders on o_orderkey = l_orderkey), y as (select a subject, b counterparty, 0 i, m o from x union all select b, a, m, 0 from x)
 select subject, counterparty, cast(sum(i) as double) money_in, cast(sum(o) as double) money_out, cast(count(*) as bigint) n from y group by all""")
def money_flow(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.col("l_extendedprice").alias("amount"))
    return R.in_out(x, "subject")


@query("""with g as (select user_id, cast(h as int) as hour from (select distinct user_id from events), range(24) r(h)), n as (select user_id, cast(hour(ts) as int) as hour, count(*) n from events group by all) select user_id, hour, cast(coalesce(n, 0) as bigint) n from g left join n using (user_id, hour)""")
def call_profile_by_hour(t: Tables) -> DataFrame:
    return R.by_hour(t.events, "user_id")


@query("""select c_nationkey, cast(count(distinct o_custkey) as bigint) actors, round(cast(avg(cast(o_totalprice as decimal(38,4))) as double), 4) mean, cast(least(1.0, max(o_totalprice) / 500000) as double) threat from orders join customer on c_custkey = o_custkey group by 1""")
def location_activity(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy("c_nationkey").agg(F.count_distinct("o_custkey").alias("actors"), F.round(F.avg(F.col("o_totalprice").cast("decimal(38,4)")).cast("double"), 4).alias("mean"), F.least(F.lit(1.0), F.max("o_totalprice") / 500000).alias("threat"))


@query("""with o as (select n_regionkey r, o_orderkey, o_orderdate, o_totalprice, row_number() over (partition by n_regionkey order by o_orderdate desc, o_orderkey) k from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)
 select r, cast(count(*) as bigint) orders, cast(count(*) filter (o_totalprice > 200000) as bigint) poi, string_agg(cast(o_orderkey as varchar), ',' order by k) filter (k <= 5) latest from o group by 1""")
def region_rollup(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumnRenamed("n_regionkey", "r")
    all_ = o.groupBy("r").agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 200000).alias("poi"))
    last = R.top_per_group(o.select("r", "o_orderkey", "o_orderdate"), ["r"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5)
    last = last.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("o_orderkey").cast("string").alias("k")))), lambda s: s["k"]), ",").alias("latest"))
    return all_.join(last, "r")


@query("""with roster(name, feed) as (values ('bursts', 'click'), ('hubs', 'error'), ('night', 'view'), ('offshore', 'leak')), n as (select event_type, count(*) n from events group by 1), f as (select event_type, count(*) f from events where value > 60 group by 1)
 select name, feed, coalesce(n, 0) n, case when coalesce(n, 0) = 0 then 'starved' when coalesce(f, 0) > 0 then 'fired' else 'silent' end state from roster left join n on feed = n.event_type left join f on feed = f.event_type""")
def detector_roster(t: Tables) -> DataFrame:
    roster = t.spark.createDataFrame([("bursts", "click"), ("hubs", "error"), ("night", "view"), ("offshore", "leak")], "name string, feed string")
    n = t.events.groupBy(F.col("event_type").alias("feed")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("f"))
    j = roster.join(n, "feed", "left").na.fill(0, ["n", "f"])
    return j.select("name", "feed", "n", F.when(F.col("n") == 0, "starved").when(F.col("f") > 0, "fired").otherwise("silent").alias("state"))


@query("""with a as (select o_orderkey, o_orderpriority sev, unnest(['C'||o_custkey, 'N'||(o_custkey % 25)]) e from orders where o_orderstatus = 'P') select distinct e from a where sev in ('1-URGENT', '2-HIGH')""")
def pending_set(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderstatus = 'P' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    return a.select(F.explode(F.array(F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("N"), F.col("o_custkey") % 25))).alias("e")).distinct()


@query("select user_id, cast(count(*) as bigint) n, cast(sum(cast(value as decimal(38,4))) as double) amount, string_agg(distinct strftime(ts, '%a'), ',' order by strftime(ts, '%a')) weekdays from events where event_type = 'error' group by 1")
def complaint_rollup(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,4)")).cast("double").alias("amount"), F.concat_ws(",", F.array_sort(F.collect_set(F.date_format("ts", "EEE")))).alias("weekdays"))


@query("select e, cast(max(score) as double) score from (select o_totalprice / 1000000 score, unnest(['C'||o_custkey, 'P'||o_orderpriority]) e from orders) group by 1")
def max_score_per_entity(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_totalprice") / 1000000).alias("score"), F.explode(F.array(F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("P"), "o_orderpriority"))).alias("e")).groupBy("e").agg(F.max("score").alias("score"))


@query("select o_custkey, cast(count(*) filter (o_orderstatus = 'F') as bigint) accused, cast(count(*) filter (o_orderpriority = '1-URGENT') as bigint) urgent, max(case when o_totalprice > 300000 then 0.6 else 0.0 end)::double listed from orders group by 1")
def actor_signals(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("accused"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max(F.when(F.col("o_totalprice") > 300000, 0.6).otherwise(0.0)).alias("listed"))


@query("""with k as (select source, list_sort(list_distinct(list(lang))) langs, count(*) n from documents group by 1) select source, array_to_string(langs, '+') kinds, case when len(langs) = 1 then 'single' when list_contains(langs, 'es') then 'mixed-es' else 'mixed' end title from k""")
def sheet_identity(t: Tables) -> DataFrame:
    k = t.documents.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return k.select("source", F.array_join("langs", "+").alias("kinds"), F.when(F.size("langs") == 1, "single").when(F.array_contains("langs", "es"), "mixed-es").otherwise("mixed").alias("title"))


@query("""with r as (select user_id, string_agg(event_type, '>' order by ts, event_id) route from (select *, row_number() over (partition by user_id order by ts, event_id) k from events) where k <= 3 group by 1) select route, cast(count(*) as bigint) runs from r group by 1""")
def collect_routes(t: Tables) -> DataFrame:
    first = R.top_per_group(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], 3)
    r = first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda s: s["event_type"]), ">").alias("route"))
    return r.groupBy("route").agg(F.count("*").alias("runs"))


@query("""with f as (select user_id, cast(count(*) as double) n, cast(round(cast(sum(cast(value as decimal(38,4))) as double), 2) as double) s, cast(count(distinct event_type) as double) k from events group by 1),
 o as (select user_id, greatest(-ln(cume_dist() over (order by n)), -ln(cume_dist() over (order by n desc))) + greatest(-ln(cume_dist() over (order by s)), -ln(cume_dist() over (order by s desc))) + greatest(-ln(cume_dist() over (order by k)), -ln(cume_dist() over (order by k desc))) score from f) select user_id, round(score, 6) score from o""")
def ecod_scores(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.round(F.sum(F.col("value").cast("decimal(38,4)")).cast("double"), 2).alias("s"), F.count_distinct("event_type").cast("double").alias("k"))
    return R.ecod(f, "user_id", ["n", "s", "k"]).withColumn("score", F.round("score", 6))


@query("""with p as (select o_orderpriority truth, o_orderstatus found from orders), c as (select truth, found, cast(count(*) as double) n from p group by all), a as (select truth, sum(n) n from c group by 1), b as (select found, sum(n) n from c group by 1), z as (select sum(n) t, sum(n*(n-1)/2) same from c),
 s as (select t, same, (select sum(n*(n-1)/2) from a) ca, (select sum(n*(n-1)/2) from b) cb, (select -sum(n/t*ln(n/t)) from a) ha, (select -sum(n/t*ln(n/t)) from b) hb, (select -sum(n/t*ln(n/t)) from c) hab, (select sum(m) from (select max(n) m from c group by found)) pure from z)
 select round((same - ca*cb/(t*(t-1)/2)) / ((ca+cb)/2 - ca*cb/(t*(t-1)/2)), 9) ari, round(2*(ha+hb-hab)/(ha+hb), 9) nmi, round(pure/t, 9) purity from s""")
def clustering_agreement(t: Tables) -> DataFrame:
    from ..operators.graph import clustering_agreement as agree

    return agree(t.orders.select(F.col("o_orderpriority").alias("truth"), F.col("o_orderstatus").alias("found"))).select(*(F.round(c, 9).alias(c) for c in ("ari", "nmi", "purity")))
