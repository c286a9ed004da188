"""Scoring models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, keys as K
from ..operators.relational import min_max
from ..plans import detectors, scoring
from . import Tables, query


def metrics(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("degree"), F.sum(F.col("o_totalprice").cast("decimal(38,4)")).cast("double").alias("weighted_degree"))
    return o.select("id", "degree", "weighted_degree", (F.col("degree") / 100).alias("pagerank"), (F.col("id") % 7 / 7.0).alias("eigenvector"), (F.col("id") % 11 / 11.0).alias("betweenness"))


METRICS = "m as (select o_custkey id, cast(count(*) as double) degree, cast(sum(cast(o_totalprice as decimal(38,4))) as double) weighted_degree, count(*) / 100 pagerank, (o_custkey % 7) / 7.0::double eigenvector, (o_custkey % 11) / 11.0::double betweenness from orders group by 1)"
_N = lambda c: f"(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()))"


@query(f"with {METRICS} select id, cast(round(cast(0.35::double * {_N('pagerank')} + 0.25::double * {_N('eigenvector')} + 0.25::double * {_N('betweenness')} + 0.15::double * {_N('weighted_degree')} as decimal(18,9)), 4) as double) influence from m")
def minmax_influence(t: Tables) -> DataFrame:
    return scoring.influence(metrics(t)).select("id", "influence")


@query(f"with {METRICS} select id, round({_N('degree')}, 9) n_degree from m")
def minmax(t: Tables) -> DataFrame:
    return min_max(metrics(t), ["degree"]).select("id", F.round("n_degree", 9).alias("n_degree"))


SIGNALS = """s as (select o_custkey id, count(*) filter (o_orderstatus = 'F') accused, count(*) filter (o_orderpriority = '1-URGENT') surveillance, count(*) filter (o_totalprice > 350000) intel, o_custkey % 5 = 0 unverified, o_custkey % 9 = 0 international, case when o_custkey % 13 = 0 then 0.7::double else 0.0::double end anomaly,
 case o_custkey % 17 when 0 then 'wanted' when 1 then 'screened' when 2 then 'weak' end watchlist, o_custkey % 17 = 0 wanted, o_custkey % 29 = 0 protected from orders group by 1)"""


def signals(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("accused"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("surveillance"), F.count_if(F.col("o_totalprice") > 350000).alias("intel"))
    k = F.col("id")
    return o.withColumns({"unverified": k % 5 == 0, "international": k % 9 == 0, "anomaly": F.when(k % 13 == 0, 0.7).otherwise(0.0), "watchlist": F.when(k % 17 == 0, "wanted").when(k % 17 == 1, "screened").when(k % 17 == 2, "weak"), "wanted": k % 17 == 0, "convicted": F.lit(0), "offshore": F.lit(False), "non_subject": F.lit(False), "protected": k % 29 == 0})


SUSPICION = """x as (select *, case when protected then 0.0::double else cast(round(cast(least(1.0::double, 0.35::double * least(accused, 2) + 0.15::double * least(surveillance, 2) + 0.2::double * least(intel, 2) + case when unverified then 0.25::double else 0 end + case when international then 0.15::double else 0 end + 0.3::double * anomaly
 + case watchlist when 'wanted' then 0.6::double when 'screened' then 0.45::double when 'weak' then 0.12::double else 0 end + case when wanted then 0.5::double else 0 end) as decimal(18,9)), 3) as double) end suspicion from s)"""


@query(f"with {SIGNALS}, {SUSPICION} select id, suspicion, protected from x")
def suspicion(t: Tables) -> DataFrame:
    return scoring.suspicion(signals(t)).select("id", "suspicion", "protected")


@query(f"with {SIGNALS}, {SUSPICION} select id, case when protected then 0.0::double else cast(round(cast(0.55::double * ((id % 100) / 100.0::double) + 0.45::double * suspicion as decimal(18,9)), 4) as double) end priority from x")
def priority_fusion(t: Tables) -> DataFrame:
    s = scoring.suspicion(signals(t))
    return s.select("id", scoring.priority(F.col("id") % 100 / 100.0, F.col("suspicion"), F.col("protected")).alias("priority"))


@query(f"with {SIGNALS}, {SUSPICION} select id, suspicion, case when suspicion >= 0.85 then 'critical' when suspicion >= 0.65 then 'high' when suspicion >= 0.4 then 'medium' else 'low' end severity from x where not protected order by suspicion desc, id limit 10")
def key_players(t: Tables) -> DataFrame:
    s = scoring.suspicion(signals(t)).withColumn("priority", F.col("suspicion"))
    return scoring.key_players(s).select("id", "suspicion", K.severity(F.col("suspicion")).alias("severity"))


@query("""with d as (select distinct event_type source, user_id entity from events where value > 90), n as (select source, count(*) n from d group by 1 having count(*) >= 3), m as (select x.source s1, y.source s2, count(*) m from d x join d y on x.entity = y.entity and x.source < y.source group by 1, 2)
 select s1, s2, a.n n1, b.n n2, m, round((a.n + 1) * (b.n + 1) / (m + 1) - 1, 6) estimate, round(greatest((a.n + 1) * (b.n + 1) / (m + 1) - 1 - 1.96 * sqrt((a.n + 1)::double * (b.n + 1) * (a.n - m) * (b.n - m) / ((m + 1) * (m + 1) * (m + 2))), a.n + b.n - m), 6) low from m join n a on a.source = s1 join n b on b.source = s2""")
def iceberg_chapman(t: Tables) -> DataFrame:
    e = scoring.iceberg(t.events.where("value > 90").select(F.col("event_type").alias("source"), F.col("user_id").alias("entity")))
    return e.select("s1", "s2", "n1", "n2", "m", F.round("estimate", 6).alias("estimate"), F.round("low", 6).alias("low"))


@query("select asset, n, cast(least(0.95, 0.6 + 0.15 * (n - 2)) as double) score from (select l_partkey asset, count(distinct l_suppkey) n from lineitem where l_returnflag = 'R' group by 1) where n >= 2")
def discrepancy_ownership(t: Tables) -> DataFrame:
    return detectors.ownership_conflicts(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("owner")))


@query("select source entity, 'lang' attribute, count(distinct lang) n, 0.5::double score from documents group by 1 having count(distinct lang) >= 2")
def discrepancy_attribute(t: Tables) -> DataFrame:
    return detectors.attribute_conflicts(t.documents.select(F.col("source").alias("entity"), F.lit("lang").alias("attribute"), F.col("lang").alias("value")))


@query("select person, n, cast(least(0.7, 0.35 + 0.02 * n) as double) score from (select l_suppkey person, count(distinct l_partkey) n from lineitem group by 1) where n >= 8")
def mass_directorship(t: Tables) -> DataFrame:
    return detectors.mass_directorship(t.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("org")))


@query("""select n_nationkey, round(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(n_regionkey * 10 - n_nationkey) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(n_regionkey * 10)) * pow(sin(radians(n_regionkey * 7 - n_nationkey * 3) / 2), 2)))), 6) km from nation""")
def haversine_km(t: Tables) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return t.nation.select("n_nationkey", F.round(geo.haversine(n, n * 3, r * 10, r * 7), 6).alias("km"))


@query("""select c_custkey, case when c_acctbal / 10000 >= 0.8 then 'critical' when c_acctbal / 10000 >= 0.6 then 'high' when c_acctbal / 10000 >= 0.3 then 'medium' when c_acctbal > 0 then 'low' else 'none' end tier,
 case when c_mktsegment in ('BUILDING') then 'solid' when c_acctbal / 10000 >= 0.95 then 'solid' when c_acctbal / 10000 >= 0.7 then 'dashed' else 'dotted' end style from customer""")
def tiers_and_styles(t: Tables) -> DataFrame:
    x = F.col("c_acctbal") / 10000
    return t.customer.select("c_custkey", K.tier(x).alias("tier"), K.line_style(F.when(F.col("c_mktsegment") == "BUILDING", "structured").otherwise("other"), x).alias("style"))


@query("""with e as (select o_custkey id, o_totalprice / 600000 score from orders), a as (select id, max(score) s from e group by 1), t as (select distinct c_custkey src, c_nationkey dst from customer), i as (select src id, 0.8::double * max(s) s from t join a on a.id = t.dst group by 1) select id, round(max(s), 9) anomaly from (select * from a union all select * from i) group by 1""")
def anomaly_inheritance(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_totalprice") / 600000).alias("anomaly"))
    ties = t.customer.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.lit("OWNS").alias("rel_type"))
    return scoring.inherited(a, ties).withColumn("anomaly", F.round("anomaly", 9))


@query(f"""with {METRICS}, {SIGNALS}, {SUSPICION}, j as (select m.*, suspicion from m join x using (id)),
 c as (select quantile_cont(degree, 0.75) d75, quantile_cont(degree, 0.9) d90, quantile_cont(pagerank, 0.85) p85, quantile_cont(betweenness, 0.85) b85 from j)
 select id, case when id % 15 = 0 then 'unverified' when id % 10 = 0 and weighted_degree > 200000 then 'financial'
 when suspicion >= 0.2 and betweenness > 0 and betweenness >= b85 then 'broker' when suspicion >= 0.2 and pagerank >= p85 and degree >= d75 then 'coordinator'
 when suspicion >= 0.2 then 'operative' when degree >= d90 then 'connector' else 'peripheral' end role from j, c""")
def roles(t: Tables) -> DataFrame:
    m = metrics(t).join(scoring.suspicion(signals(t)).select("id", "suspicion"), "id").withColumns({"type": F.when(F.col("id") % 10 == 0, "ORGANIZATION").otherwise("PERSON"), "amount": F.col("weighted_degree"), "unverified": F.col("id") % 15 == 0, "leader": F.lit(False)})
    return scoring.roles(m).select("id", "role")


@query("""with n as (select cast(l_partkey as varchar) asset, count(distinct l_suppkey) n from lineitem where l_returnflag = 'R' group by 1),
 a as (select 'ownership_conflict' kind, 'Asset ' || asset title, least(0.95::double, 0.6::double + 0.15::double * (n - 2)) score, asset entity_ids, asset part from n where n >= 2
 union all select 'detector_error', 'broken failed', 0.1::double, '', 'broken')
 select sha256(kind || '|' || part) id, kind, case when score >= 0.85 then 'critical' when score >= 0.65 then 'high' when score >= 0.4 then 'medium' else 'low' end severity,
 title, score, entity_ids, 'open' status, 'pending' review_status, 1 failures from a""")
def alert_roundtrip(t: Tables) -> DataFrame:
    """Detectors in isolation, one of which fails, then alerts by content and the upsert."""
    own = detectors.ownership_conflicts(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("owner")))
    jobs = {"ownership": lambda: detectors.alerts(own, "ownership_conflict", ["asset"], F.concat(F.lit("Asset "), F.col("asset"))), "broken": lambda: own.select("no_such_column")}
    found, failed = detectors.run_all(jobs)
    stored = found.limit(0).withColumns({"status": F.lit("open"), "review_status": F.lit("pending")})
    return detectors.persisted(stored, found).withColumn("entity_ids", F.array_join("entity_ids", ",")).withColumn("failures", F.lit(len(failed)))


@query()
def behavioural_outliers(t: Tables) -> DataFrame:
    from ..plans.outliers import outliers

    f = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("degree"), F.sum(F.col("o_totalprice").cast("decimal(38,4)")).cast("double").alias("tx_out"), F.count_distinct("o_orderpriority").alias("tx_counterparties"), F.max("o_totalprice").alias("tx_in"))
    o = outliers(f, "id", ("degree", "tx_out", "tx_counterparties", "tx_in"))
    return o.select("id", F.round("ecod", 6).alias("ecod"), F.round("forest", 6).alias("forest"), "both", F.round("score", 6).alias("score"), "drivers")


@query("""with k as (select lang || source component, count(*) size from documents group by 1), o as (select component, size, coalesce(sum(size) over (order by size desc, component rows between unbounded preceding and 1 preceding), 0) b from k) select component, size from o where b < 120""")
def display_components(t: Tables) -> DataFrame:
    from ..plans.outliers import shown_components

    return shown_components(t.documents.select(F.concat("lang", "source").alias("component")))
