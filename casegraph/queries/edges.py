"""Edges: accumulation, merge, projection, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges as E
from . import Tables, query


def money(t: Tables) -> DataFrame:
    """Observations customer -> supplier."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    line = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    j = o.join(line, o.o_orderkey == line.l_orderkey)
    return j.select(
        F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.lit("TRANSFERRED_TO").alias("rel_type"), F.lit(1.0).alias("weight"), F.col("o_orderdate").alias("at"), (1 - F.col("l_discount")).alias("confidence"),
        F.round((F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(18,4)"))), 4).cast("double").alias("amount"), F.col("l_quantity").cast("long").alias("duration"), (F.month("o_orderdate") == 12).alias("night"), F.col("o_orderpriority").alias("attr"),
        F.concat_ws("-", F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.col("l_linenumber").cast("string")).alias("order"),
    )


MONEY_SQL = """money as (select 'C'||o_custkey as src, 'S'||l_suppkey as dst, o_orderdate as seen, 1 - l_discount as confidence,
 cast(round(cast(l_extendedprice as decimal(18,4)) * (1 - cast(l_discount as decimal(18,4))), 4) as double) as amount, cast(l_quantity as bigint) as duration, month(o_orderdate) = 12 as night, o_orderpriority as attr,
 strftime(o_orderdate, '%Y%m%d') || '-' || lpad(cast(o_orderkey as varchar), 10, '0') || '-' || l_linenumber as ord
 from orders join lineitem on o_orderkey = l_orderkey)"""

EDGE_SQL = """select src, dst, 'TRANSFERRED_TO' as rel_type, cast(count(*) as double) as weight, count(*) as count, max(confidence) as confidence, min(seen) as first_seen, max(seen) as last_seen,
 cast(sum(cast(amount as decimal(38,4))) as double) as total_amount, max(amount) as max_amount, cast(sum(duration) as bigint) as total_duration, cast(sum(cast(night as int)) as bigint) as night_count, arg_min(attr, ord) as attr from money group by src, dst"""


@query(f"with {MONEY_SQL} {EDGE_SQL}")
def edge_accumulate(t: Tables) -> DataFrame:
    return E.accumulate(money(t))


@query(f"with {MONEY_SQL} {EDGE_SQL}")
def edge_merge_incremental(t: Tables) -> DataFrame:
    m = money(t)
    return E.merged(E.accumulate(m.where("at < '1998-01-01'")), E.accumulate(m.where("at >= '1998-01-01'")))


@query(f"with {MONEY_SQL} select src, dst, ord as \"order\", attr, nth from (select *, row_number() over (partition by src, dst order by ord) nth from money) where nth <= 12")
def edge_evidence(t: Tables) -> DataFrame:
    return E.evidence(money(t)).select("src", "dst", "order", "attr", F.col("nth").cast("long"))


@query(f"""with {MONEY_SQL}, e as ({EDGE_SQL}), w as (select src, cast(sum(cast(round(log10(greatest(total_amount, 10)) * sqrt(count) / 2, 6) as decimal(18,6))) as double) as weighted, count(*) as degree, cast(sum(cast(total_amount as decimal(38,4))) as double) as total from e group by src)
 select src, weighted, degree, total from w order by weighted desc, src limit 20""")
def top_senders(t: Tables) -> DataFrame:
    """The flagship: accumulated money graph, transfer weights, weighted degree, top 20."""
    e = E.accumulate(money(t))
    w = F.round(E.transfer_weight(F.col("total_amount"), F.col("count")), 6).cast("decimal(18,6)")
    g = e.groupBy("src").agg(F.sum(w).cast("double").alias("weighted"), F.count("*").alias("degree"), F.sum(F.col("total_amount").cast("decimal(38,4)")).cast("double").alias("total"))
    return g.orderBy(F.desc("weighted"), "src").limit(20)


@query("""with e as (select l_partkey src, l_suppkey dst, 'SUPPLIES' rel, cast(l_quantity as double) w, 1 c from lineitem union all select l_suppkey, l_partkey, 'RETURNS', 0.0, 0 from lineitem where l_returnflag = 'R')
 select least(src,dst) a, greatest(src,dst) b, cast(sum(cast(case when w = 0 then 1 else w end as decimal(38,4))) as double) weight, cast(sum(case when c = 0 then 1 else c end) as bigint) count, string_agg(distinct rel, ',' order by rel) rel_types from e where src <> dst group by 1, 2""")
def undirected_collapse(t: Tables) -> DataFrame:
    line = t.lineitem
    e = line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("SUPPLIES").alias("rel_type"), F.col("l_quantity").cast("double").alias("weight"), F.lit(1).alias("count"))
    e = e.unionAll(line.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey", F.lit("RETURNS"), F.lit(0.0), F.lit(0)))
    return E.collapsed(e)


@query("""with m as (select distinct l_orderkey g, l_suppkey s from lineitem), n as (select g from m group by g having count(*) between 2 and 30)
 select x.s a, y.s b, count(*) weight from m x join n using (g) join m y on x.g = y.g and x.s < y.s group by 1, 2""")
def actor_projection_shared_case(t: Tables) -> DataFrame:
    return E.co_members(t.lineitem, "l_orderkey", "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("weight"))


@query("""with p as (select l_suppkey a, o_custkey b, case when l_returnflag = 'R' then 'returns' else 'sales' end channel from lineitem join orders on l_orderkey = o_orderkey), n as (select a, b, channel, count(*) n from p group by all)
 select a, b, string_agg(channel || '=' || n, ',' order by channel || '=' || n) channels, cast(sum(n) as bigint) n from n group by a, b""")
def projection_channels_map(t: Tables) -> DataFrame:
    p = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("a"), F.col("o_custkey").alias("b"), F.when(F.col("l_returnflag") == "R", "returns").otherwise("sales").alias("channel"))
    n = p.groupBy("a", "b", "channel").agg(F.count("*").alias("n"))
    return n.groupBy("a", "b").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "channel", "n")))).alias("channels"), F.sum("n").alias("n"))


@query("""select cn.c_nationkey a, sn.s_nationkey b, cast(count(*) as bigint) n, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) amount from lineitem join orders on l_orderkey = o_orderkey join customer cn on c_custkey = o_custkey join supplier sn on s_suppkey = l_suppkey where cn.c_nationkey <> sn.s_nationkey group by 1, 2""")
def proxy_owner_fold(t: Tables) -> DataFrame:
    e = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("amount"))
    owners = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("proxy"), F.col("c_nationkey").alias("owner")).unionAll(t.supplier.select(F.concat(F.lit("S"), "s_suppkey"), F.col("s_nationkey")))
    return E.folded(e, owners).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("""with ps as (select distinct l_partkey p, l_suppkey s from lineitem where l_returnflag = 'R'), listed as (select p_partkey p from part where p_size = 1)
 select x.p listed, y.p other, cast(count(*) as bigint) shared, cast(least(0.85, 0.5 + 0.05 * count(*)) as double) score from ps x join listed using (p) join ps y on x.s = y.s and x.p <> y.p group by 1, 2 having count(*) >= 2""")
def director_two_hop(t: Tables) -> DataFrame:
    """Two organisations by a shared director: a listed one and others."""
    ps = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    listed = t.part.where("p_size = 1").select(F.col("p_partkey").alias("p"))
    x = ps.join(listed, "p", "left_semi").withColumnRenamed("p", "listed")
    n = x.join(ps.withColumnRenamed("p", "other"), "s").where("listed <> other").groupBy("listed", "other").agg(F.count("*").alias("shared")).where("shared >= 2")
    return n.withColumn("score", F.least(F.lit(0.85), 0.5 + 0.05 * F.col("shared")))


@query("""with known as (select c_custkey id from customer where c_mktsegment = 'BUILDING'), e as (select o_custkey a, l_suppkey + 1000000 b from orders join lineitem on l_orderkey = o_orderkey)
 select case when a in (select id from known) then b else a end id, cast(count(*) as bigint) n from e where (a in (select id from known)) <> (b in (select id + 1000000 from known)) group by 1""")
def xor_closure(t: Tables) -> DataFrame:
    """Counterparts of links of which exactly one end is known."""
    known = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    known = known.unionAll(known.select(F.col("id") + 1000000)).withColumn("k", F.lit(True))
    e = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    j = e.join(known.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a", "left").join(known.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b", "left")
    one = j.where(F.col("ka").isNull() != F.col("kb").isNull())
    return one.groupBy(F.when(F.col("ka").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("id")).agg(F.count("*").alias("n"))


@query("""with pairs as (select l_suppkey s, l_partkey p, min(l_orderkey) first from lineitem group by all) select s, arg_min(p, first * 100000 + p) p from pairs group by s""")
def first_holder(t: Tables) -> DataFrame:
    """First-wins map."""
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("first"))
    return pairs.groupBy(F.col("l_suppkey").alias("s")).agg(F.min_by("l_partkey", F.col("first") * 100000 + F.col("l_partkey")).alias("p"))


@query("""with v as (select c_custkey, 1 pos, c_custkey * 2 k from customer union all select c_custkey, 2, c_custkey + 7 from customer union all select c_custkey, 3, c_custkey % 50 from customer)
 select c.c_custkey, (select arg_min(s_name, pos) from v join supplier on s_suppkey = k where v.c_custkey = c.c_custkey) found from customer c""")
def multi_key_lookup(t: Tables) -> DataFrame:
    from ..operators.relational import first_known

    k = F.col("c_custkey")
    return first_known(t.customer.select("c_custkey"), k, [k * 2, k + 7, k % 50], t.supplier, "s_suppkey", "s_name")
