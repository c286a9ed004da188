"""Graph queries over the part co-occurrence graph and small closed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.blocks import removal_impact as removal
from ..operators.centrality import hyperball
from ..operators.components import components
from ..operators.edges import both_ways, co_members
from ..operators.store import written
from . import Tables, query

PARTS = "m as (select distinct l_orderkey g, l_partkey p from lineitem), pg as (select x.p a, y.p b, cast(count(*) as double) weight from m x join m y on x.g = y.g and x.p < y.p group by 1, 2 having count(*) >= {w})"
P2, P3 = PARTS.format(w=2), PARTS.format(w=3)
BOTH = "bw as (select a u, b v, weight from pg union all select b, a, weight from pg)"


def parts(t: Tables, least: int) -> DataFrame:
    e = co_members(t.lineitem, "l_orderkey", "l_partkey").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight")).where(F.col("weight") >= least)
    return written(e, "parts")


@query(f"with {P2}, {BOTH} select u id, cast(count(*) as bigint) degree, sum(weight) weighted_degree from bw group by 1")
def degree(t: Tables) -> DataFrame:
    return G.degrees(parts(t, 2))


@query(f"with {P2}, {BOTH} select cast(n as bigint) nodes, cast(e as bigint) edges, round(2.0 * e / (n * (n - 1)), 9) density from (select count(distinct u) n, (select count(*) from pg) e from bw)")
def density(t: Tables) -> DataFrame:
    return G.density(parts(t, 2)).withColumn("density", F.round("density", 9))


@query(f"""with {P2}, {BOTH}, mx as (select max(weight) w from pg), d as (select u, count(*) k from bw group by 1), tr as (select x.u id, sum(cbrt((x.weight / w) * (y.weight / w) * (z.weight / w))) s from bw x join bw y on x.u = y.u and x.v < y.v join pg z on z.a = x.v and z.b = y.v cross join mx group by 1)
 select d.u id, round(case when k < 2 then 0 else 2 * coalesce(s, 0) / (k * (k - 1)) end, 6) coefficient from d left join tr on d.u = tr.id""")
def clustering(t: Tables) -> DataFrame:
    return G.clustering(parts(t, 2)).withColumn("coefficient", F.round("coefficient", 6))


@query(f"""with recursive {P3}, {BOTH}, r(id, c) as (select u, u from bw union select v, c from r join bw on u = id) select id, min(c) component from r group by 1""")
def connected_components(t: Tables) -> DataFrame:
    return components(parts(t, 3)).select(F.col("node").alias("id"), "component")


_RANK = "r{i} as (select v id, 0.15 / n + 0.85 * sum(rank * p) rank from ar join r{p} on u = id cross join nn group by v, n)"


@query(f"""with {P2}, {BOTH}, st as (select u, sum(weight) s from bw group by 1), ar as (select u, v, weight / s p from bw join st using (u)), nn as (select count(*) n from st), r0 as (select u id, 1.0 / n rank from st, nn), {', '.join(_RANK.format(i=i, p=i - 1) for i in range(1, 6))}
 select id, round(cast(rank as decimal(18,9)), 7)::double rank from r5""")
def pagerank_fixed(t: Tables) -> DataFrame:
    r = G.pagerank(parts(t, 2), rounds=5, tolerance=0.0)
    return r.select("id", F.round(F.col("rank").cast("decimal(18,9)"), 7).cast("double").alias("rank"))


@query(f"""with {P2}, {BOTH}, d as (select u, count(*) k from bw group by 1), h as (select x.v a, y.v b, count(*) common, sum(1 / ln(k)) aa from bw x join bw y on x.u = y.u and x.v < y.v join d on d.u = x.u group by 1, 2)
 select h.a, h.b, cast(common as bigint) common, round(aa, 6) adamic_adar, round(common / (da.k + db.k - common), 6) jaccard from h left join pg on pg.a = h.a and pg.b = h.b join d da on da.u = h.a join d db on db.u = h.b where pg.a is null and common >= 2""")
def link_prediction(t: Tables) -> DataFrame:
    return G.two_hop(parts(t, 2)).where("common >= 2").select("a", "b", "common", F.round("adamic_adar", 6).alias("adamic_adar"), F.round("jaccard", 6).alias("jaccard"))


@query(f"""with {P2}, {BOTH}, d as (select u, count(*) k from bw group by 1), com as (select u id, u % 20 c from d), h as (select x.v a, y.v b, count(*) common from bw x join bw y on x.u = y.u and x.v < y.v group by 1, 2)
 select h.a, h.b, cast(common as bigint) common, round(common / (da.k + db.k - common), 6) jaccard from h left join pg on pg.a = h.a and pg.b = h.b join d da on da.u = h.a join d db on db.u = h.b where pg.a is null and common >= 2 and h.a % 20 = h.b % 20 and round(common / (da.k + db.k - common), 6) >= 0.15""")
def ghost_pairs(t: Tables) -> DataFrame:
    from ..plans.scoring import ghosts

    e = parts(t, 2)
    of = both_ways(e, "a", "b").select(F.col("u").alias("id"), (F.col("u") % 20).alias("community")).distinct()
    return ghosts(e, of, least_jaccard=0.15).select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"))


@query(f"with {P2}, {BOTH}, s as (select 7 id, 0 as hop union all select distinct v, 1 from bw where u = 7), t as (select id, hop from s union all select distinct v, 2 from bw where u in (select id from s)) select id, min(hop) as hop from t group by 1")
def k_hop_ego(t: Tables) -> DataFrame:
    return G.ego(parts(t, 2), t.spark.createDataFrame([(7,)], "id long"), 2)


@query("""with recursive g as (select 'C'||c_custkey a, 'N'||c_nationkey b from customer union all select 'S'||s_suppkey, 'N'||s_nationkey from supplier union all select 'N'||n_nationkey, 'R'||n_regionkey from nation), bw as (select a u, b v from g union all select b, a from g),
 p(at_, path, n) as (select 'C3', ['C3'], 0 union all select v, path || [v], n + 1 from p join bw on u = at_ where n < 6 and not list_contains(path, v) and at_ <> 'S38') select n length, array_to_string(path, '>') as path from p where at_ = 'S38' order by length, path limit 3""")
def bounded_paths(t: Tables) -> DataFrame:
    n = lambda df, a, pa, b, pb: df.select(F.concat(F.lit(pa), a).alias("a"), F.concat(F.lit(pb), b).alias("b"))
    g = n(t.customer, "c_custkey", "C", "c_nationkey", "N").unionAll(n(t.supplier, "s_suppkey", "S", "s_nationkey", "N")).unionAll(n(t.nation, "n_nationkey", "N", "n_regionkey", "R"))
    return G.paths(g, "C3", "S38", k=3, cutoff=6)


@query(f"""with {P3}, {BOTH}, src as (select distinct u id, p_size / 100.0::double score from bw join part on p_partkey = u where p_size >= 20), h0 as (select id source, id, score, 0 as hop from src), h1 as (select source, v id, score, 1 as hop from h0 join bw on u = id where v <> source),
 h2 as (select distinct source, v id, score, 2 as hop from h1 join bw on u = id where (source, v) not in (select (source, id) from h0 union all select (source, id) from h1)), h3 as (select distinct source, v id, score, 3 as hop from h2 join bw on u = id where (source, v) not in (select (source, id) from h0 union all select (source, id) from h1 union all select (source, id) from h2)),
 a as (select * from h1 union all select * from h2 union all select * from h3) select id, round(max(score * case as_hop when 1 then 1.0::double when 2 then 0.3::double else 0.09::double end), 6) risk, cast(min(as_hop) as int) as hop, cast(count(*) as bigint) sources from (select source, id, score, hop as as_hop from a) group by 1""")
def proximity_3hop(t: Tables) -> DataFrame:
    e = parts(t, 3)
    src = both_ways(e, "a", "b").join(t.part.where("p_size >= 20"), F.col("u") == F.col("p_partkey")).select(F.col("u").alias("id"), (F.col("p_size") / 100).alias("score")).distinct()
    return G.proximity(e, src).withColumn("risk", F.round("risk", 6))


@query()
def betweenness_closeness(t: Tables) -> DataFrame:
    c = G.path_centralities(parts(t, 3))
    return c.select("id", F.round("betweenness", 9).alias("betweenness"), F.round("closeness", 9).alias("closeness"))


@query()
def eigenvector(t: Tables) -> DataFrame:
    return G.eigenvector(parts(t, 3)).withColumn("eigenvector", F.round("eigenvector", 6))


@query()
def louvain(t: Tables) -> DataFrame:
    return G.louvain(parts(t, 3))


#: Hops between all pairs: distinct (source, node, length of a walk), walks no longer than there are nodes.
HOPS = """nn as (select count(distinct u) n from bw), w(s, v, d) as (select distinct u, u, 0::bigint from bw union select s, bw.v, d + 1 from w join bw on bw.u = w.v, nn where d < n),
 dist as (select s, v, min(d) d from w group by s, v)"""


@query(f"""with recursive {P3}, {BOTH}, {HOPS}, sg as (select distinct u s, u v, 0::bigint d, 1::double k from bw union all
  select sg.s, bw.v, sg.d + 1, sum(k) from sg join bw on bw.u = sg.v join dist on dist.s = sg.s and dist.v = bw.v and dist.d = sg.d + 1 group by sg.s, bw.v, sg.d + 1),
 b as (select x.v id, sum(x.k * y.k / z.k) b from sg x join sg y on y.s = x.v join sg z on z.s = x.s and z.v = y.v and z.d = x.d + y.d where x.v <> x.s and y.v <> x.v group by 1),
 c as (select s id, case when sum(d) > 0 then (count(*) - 1) / sum(d) * (count(*) - 1) / (max(n) - 1) else 0 end c from dist, nn group by s)
 select id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) betweenness, round(c, 9) closeness from c left join b using (id), nn""")
def betweenness_by_hops(t: Tables) -> DataFrame:
    c = G.path_centralities(parts(t, 3), weighted=False)
    return c.select("id", F.round("betweenness", 9).alias("betweenness"), F.round("closeness", 9).alias("closeness"))


@query(f"""with recursive {P3}, {BOTH}, {HOPS} select s id, round(case when sum(d) > 0 then (count(*) - 1) / sum(d) * (count(*) - 1) / (max(n) - 1) else 0 end, 4) closeness from dist, nn group by s""")
def closeness_by_sketches(t: Tables) -> DataFrame:
    """Balls of up to some hundred nodes are counted exactly, so the sketches give the exact closeness of this graph to four digits."""
    return hyperball(parts(t, 3)).select("id", F.round("closeness", 4).alias("closeness"))


@query(f"""with recursive {P3}, {BOTH}, nd as (select distinct u id, u % 5 c from bw), go(s, v) as (select id, id from nd union select s, bw.v from go join bw on u = go.v),
 off(x, s, v) as (select g.s, g.v, g.v from go g where g.s <> g.v union select x, s, bw.v from off join bw on u = off.v where bw.v <> x),
 mo as (select x, s, count(*) n, min(v) r from off group by x, s), a as (select x id, count(distinct r) parts, sum(n - 1) / 2 pairs, count(*) filter (n = 1) alone from mo group by x),
 h as (select s id, count(*) n, min(v) r from go group by s), k as (select count(distinct r) comps from h),
 cw as (select bw.*, x.c from bw join nd x on x.id = u join nd y on y.id = v where x.c = y.c), gc(s, v) as (select id, id from nd union select s, cw.v from gc join cw on u = gc.v),
 hc as (select s id, c, count(*) n from gc join nd on nd.id = s group by all), pc as (select c, sum(n - 1) / 2 pairs, sum(1.0 / n) comps from hc group by c),
 oc(x, s, v) as (select a.id, b.id, b.id from nd a join nd b on a.c = b.c and a.id <> b.id union select x, s, cw.v from oc join cw on u = oc.v where cw.v <> x),
 mc as (select x, s, count(*) n, min(v) r from oc group by x, s), ac as (select x id, count(distinct r) parts, sum(n - 1) / 2 pairs, list_sort(list(s) filter (n = 1))[:10] gone from mc group by x),
 fl as (select c, sum(weight) f from cw group by c), tc as (select u id, sum(weight) t from cw group by u)
 select nd.id, cast(every as bigint) components_before, cast(every - 1 + coalesce(a.parts, 0) as bigint) components_after, cast(h.n * (h.n - 1) // 2 as bigint) pairs_before, cast(coalesce(a.pairs, 0) as bigint) pairs_after, cast(coalesce(alone, 0) as bigint) isolated,
 round(1 - coalesce(a.pairs, 0) / (h.n * (h.n - 1) / 2), 6) loss, nd.c community, round(case when pc.pairs > 0 then 1 - coalesce(ac.pairs, 0) / pc.pairs else 0 end, 6) community_loss, cast(coalesce(ac.parts, 0) as bigint) community_components_after,
 coalesce(array_to_string(gone, ','), '') isolated_after, round(case when f > 0 then coalesce(t, 0) / (f / 2) else 0 end, 6) flow_share
 from nd join h using (id) cross join (select comps as every from k) left join a using (id) left join ac using (id) join pc on pc.c = nd.c left join fl on fl.c = nd.c left join tc on tc.id = nd.id""")
def removal_impact(t: Tables) -> DataFrame:
    """Every node, by the block-cut tree; communities by the remainder of the id."""
    e = parts(t, 3)
    of = both_ways(e, "a", "b").select(F.col("u").alias("id"), (F.col("u") % 5).alias("community")).distinct()
    out = removal(e, community=of)
    return out.withColumns({c: F.round(c, 6) for c in ("loss", "community_loss", "flow_share")} | {"isolated_after": F.array_join("isolated_after", ",")})


@query(f"with {P2}, {BOTH}, d as (select u, count(*) k from bw group by 1), s as (select distinct u id from bw join part on p_partkey = u where p_size = 7), hubs as (select u from d where k > 12 and u not in (select id from s)), n1 as (select distinct v id from bw where u in (select id from s) and v not in (select u from hubs) union select id from s), n2 as (select distinct v id from bw where u in (select id from n1) and v not in (select u from hubs) union select id from n1) select id from n2")
def hub_pruned_neighbours(t: Tables) -> DataFrame:
    e = parts(t, 2)
    return G.pruned_neighbours(e, both_ways(e, "a", "b").join(t.part.where("p_size = 7"), F.col("u") == F.col("p_partkey")).select(F.col("u").alias("id")).distinct(), hops=1, most_degree=12)
