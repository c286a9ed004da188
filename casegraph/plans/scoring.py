"""Scoring models: influence, suspicion, priority, roles, first-time risk, ghosts, icebergs, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import graph as G
from ..operators.edges import both_ways
from ..operators.relational import column_quantiles, min_max, top_per_group

# Weights of the models.
INFLUENCE = {"pagerank": 0.35, "eigenvector": 0.25, "betweenness": 0.25, "weighted_degree": 0.15}
LISTED = {"wanted": 0.6, "screened": 0.45, "weak": 0.12, "listed": 0.18}


def influence(metrics: DataFrame) -> DataFrame:
    """`metrics` with influence: min-max of each measure, weighted."""
    scaled = min_max(metrics, list(INFLUENCE))
    total = sum((F.col(f"n_{c}") * w for c, w in INFLUENCE.items()), F.lit(0.0))
    return scaled.withColumn("influence", F.round(total.cast("decimal(18,9)"), 4).cast("double")).drop(*(f"n_{c}" for c in INFLUENCE))


def suspicion(s: DataFrame) -> DataFrame:
    """From one row an actor with the signals accused, surveillance, intel, unverified, international, anomaly, watchlist,
    wanted, convicted, offshore, non_subject, protected: suspicion and its reasons. Protected parties score zero, hard;
    non-subjects get no signal of their own attributes."""
    c = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    own = F.when(F.coalesce("non_subject", F.lit(False)), 0.0).otherwise(1.0)
    parts = {
        "named as accused": 0.35 * F.least(c("accused"), F.lit(2.0)), "in surveillance reports": 0.15 * F.least(c("surveillance"), F.lit(2.0)), "in intelligence reports": 0.2 * F.least(c("intel"), F.lit(2.0)), "unverified number": 0.25 * c("unverified"), "international contact": 0.15 * c("international"), "anomalous pattern": 0.3 * c("anomaly"),
        "on a watchlist": own * F.coalesce(*(F.when(F.col("watchlist") == k, v) for k, v in LISTED.items()), F.lit(0.0)), "wanted": own * 0.5 * c("wanted"), "convicted": 0.2 * F.least(c("convicted"), F.lit(2.0)), "offshore officer": own * 0.1 * c("offshore"),
    }
    total = F.least(F.lit(1.0), sum(parts.values(), F.lit(0.0)))
    reasons = F.filter(F.array(*(F.when(v > 0, k) for k, v in parts.items())), lambda r: r.isNotNull())
    free = F.coalesce("protected", F.lit(False))
    return s.withColumns({"suspicion": F.when(free, 0.0).otherwise(F.round(total.cast("decimal(18,9)"), 3).cast("double")), "reasons": F.when(free, F.array().cast("array<string>")).otherwise(reasons)})


def inherited(anomaly: DataFrame, ties: DataFrame) -> DataFrame:
    """(id, anomaly): an actor that owns, directs or is affiliated with an organisation inherits .8 of its anomaly."""
    got = ties.where(F.col("rel_type").isin("OWNS", "DIRECTOR_OF", "AFFILIATED_WITH")).join(anomaly.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), (0.8 * F.col("anomaly")).alias("anomaly"))
    return anomaly.unionByName(got).groupBy("id").agg(F.max("anomaly").alias("anomaly"))


def priority(influence_: Column, suspicion_: Column, protected: Column) -> Column:
    return F.when(protected, 0.0).otherwise(F.round((0.55 * influence_ + 0.45 * suspicion_).cast("decimal(18,9)"), 4).cast("double"))


def roles(m: DataFrame) -> DataFrame:
    """`m` (degree, pagerank, betweenness, suspicion, type, amount, unverified) with role: the last rule that fits."""
    cuts = (("degree", 0.75), ("degree", 0.9), ("pagerank", 0.85), ("betweenness", 0.85))
    q = column_quantiles(m, {f"_{c}{round(p * 100)}": (c, p) for c, p in cuts})
    x = m.crossJoin(F.broadcast(q))  # one row
    poi = F.col("suspicion") >= 0.2
    role = (
        F.when(F.coalesce("unverified", F.lit(False)), "unverified").when((F.col("type") == "ORGANIZATION") & (F.coalesce("amount", F.lit(0.0)) > 200_000), "financial").when(F.coalesce("leader", F.lit(False)), "leader").when(poi & (F.col("betweenness") > 0) & (F.col("betweenness") >= F.col("_betweenness85")), "broker")
        .when(poi & (F.col("pagerank") >= F.col("_pagerank85")) & (F.col("degree") >= F.col("_degree75")), "coordinator").when(poi, "operative").when(F.col("degree") >= F.col("_degree90"), "connector").otherwise("peripheral")
    )
    return x.withColumn("role", role).select(*m.columns, "role")


def leaders(m: DataFrame) -> DataFrame:
    """(id, score): in communities of five or more with three suspects and mean suspicion of .2, up to two persons within 90 % of
    the best of eigenvector(1 - .7 degree)(.5 + suspicion) with bonuses for international reach and inbound money."""
    g = m.groupBy("community").agg(F.count("*").alias("size"), F.count_if(F.col("suspicion") >= 0.2).alias("poi"), F.avg("suspicion").alias("mean"), F.max("eigenvector").alias("_e"), F.max("degree").alias("_d")).where("size >= 5 and poi >= 3 and mean >= 0.2")
    x = m.where("type = 'PERSON'").join(g, "community")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = share("eigenvector", "_e") * (1 - 0.7 * share("degree", "_d")) * (0.5 + F.col("suspicion")) * (1 + 0.5 * F.coalesce(F.col("international").cast("double"), F.lit(0.0)) + F.when(F.coalesce("inbound", F.lit(0.0)) >= 500_000, 0.3).otherwise(0.0))
    ranked = top_per_group(x.withColumn("score", s), ["community"], [F.desc("score"), F.col("id")], 2)
    return ranked.withColumn("_top", F.max("score").over(Window.partitionBy("community"))).where("score >= 0.9 * _top").select("id", "community", "score")


def key_players(m: DataFrame, k: int = 10) -> DataFrame:
    return m.where(~F.coalesce("protected", F.lit(False)) & ~F.coalesce("non_subject", F.lit(False))).orderBy(F.desc("priority"), "id").limit(k)


def proximity_risk(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, n, risk): three neighbours of suspicion .35 or more give .85, else .3 each."""
    high = scores.where("suspicion >= 0.35").select(F.col("id").alias("v"))
    n = both_ways(edges, "a", "b").join(high, "v", "left_semi").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"))
    return n.withColumn("risk", F.when(F.col("n") >= 3, 0.85).otherwise(F.least(F.lit(1.0), 0.3 * F.col("n"))))


def first_time_risk(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, risk, hop) of clean actors (suspicion below .2, never accused, not listed, not protected): the largest of decay x score x
    channel factor over suspects within three hops, not through protected parties; .85 at least with three contacts of .35."""
    free = scores.where(~F.coalesce("protected", F.lit(False))).select("id")
    open_ = edges.join(free.withColumnRenamed("id", "a"), "a", "left_semi").join(free.withColumnRenamed("id", "b"), "b", "left_semi")
    near = G.proximity(open_, scores.where("suspicion >= 0.2").select("id", F.col("suspicion").alias("score")))
    channels = both_ways(open_, "a", "b", "channels").groupBy(F.col("u").alias("id")).agg(F.max(F.size(F.split("channels", ","))).alias("c"))
    contact = proximity_risk(open_, scores).where("n >= 3").select("id", F.lit(0.85).alias("floor"))
    clean = scores.where("suspicion < 0.2 and coalesce(accused, 0) = 0 and watchlist is null").select("id")
    x = near.join(clean, "id", "left_semi").join(channels, "id", "left").join(contact, "id", "left")
    risk = F.least(F.lit(1.0), F.greatest(F.col("risk") * F.least(F.lit(3.0), 1 + 0.5 * F.coalesce("c", F.lit(0))), F.coalesce("floor", F.lit(0.0))))
    return x.withColumn("risk", risk).where("risk >= 0.15").select("id", "risk", "hop")


def first_time_blend(edges: DataFrame, scores: DataFrame, of: DataFrame, k: int = 20) -> DataFrame:
    """The other model: .6 proximity (channel factor 1.5 per channel, 3 at most) + .2 community mean + .1 share of high contacts + .1 channels / 5."""
    near = G.proximity(edges, scores.where("suspicion > 0.2").select("id", F.col("suspicion").alias("score")))
    arcs = both_ways(edges, "a", "b", "channels")
    about = arcs.join(scores.select(F.col("id").alias("v"), "suspicion"), "v").groupBy(F.col("u").alias("id")).agg(F.avg((F.col("suspicion") >= 0.35).cast("double")).alias("high"), F.max(F.size(F.split("channels", ","))).alias("c"))
    mean = of.join(scores, "id").groupBy("community").agg(F.avg("suspicion").alias("mean"))
    x = near.join(about, "id").join(of, "id").join(mean, "community").join(scores.where("suspicion < 0.2 and coalesce(accused, 0) = 0").select("id"), "id", "left_semi")
    risk = 0.6 * F.least(F.lit(1.0), F.col("risk") * F.least(F.lit(3.0), F.pow(F.lit(1.5), F.col("c")))) + 0.2 * F.col("mean") + 0.1 * F.col("high") + 0.1 * F.least(F.lit(1.0), F.col("c") / 5)
    return x.withColumn("risk", risk).where("risk >= 0.15").orderBy(F.desc("risk"), "id").limit(k).select("id", "risk", "hop")


def ghosts(edges: DataFrame, of: DataFrame, scores: DataFrame | None = None, least_common: int = 2, least_jaccard: float = 0.55, k: int | None = None) -> DataFrame:
    """Pairs of one community without an edge that share neighbours: an unseen go-between. confidence: jaccard x (1 + half the suspicions)."""
    x, y = of.select(F.col("id").alias("a"), F.col("community").alias("ca")), of.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    p = G.two_hop(edges).where(F.col("common") >= least_common).join(x, "a").join(y, "b").where((F.col("ca") == F.col("cb")) & (F.round("jaccard", 6) >= least_jaccard))
    if scores is not None:
        s = scores.select("id", "suspicion")
        p = p.join(s.select(F.col("id").alias("a"), F.col("suspicion").alias("sa")), "a", "left").join(s.select(F.col("id").alias("b"), F.col("suspicion").alias("sb")), "b", "left")
        p = p.withColumn("confidence", F.least(F.lit(1.0), F.col("jaccard") * (1 + 0.5 * (F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0))))))
    else:
        p = p.withColumn("confidence", F.least(F.lit(1.0), F.col("jaccard")))
    p = p.withColumnRenamed("ca", "community").drop("cb")
    return p.orderBy(F.desc("confidence"), "a", "b").limit(k) if k else p


def iceberg(seen: DataFrame, least: int = 3) -> DataFrame:
    """(s1, s2, n1, n2, m, estimate, low, high): Chapman's capture-recapture over each pair of sources (source, entity) that share an entity."""
    d = seen.select("source", "entity").distinct()
    n = d.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    d = d.join(n, "source")
    m = d.select(F.col("source").alias("s1"), F.col("n").alias("n1"), "entity").join(d.select(F.col("source").alias("s2"), F.col("n").alias("n2"), "entity"), "entity").where("s1 < s2").groupBy("s1", "s2", "n1", "n2").agg(F.count("*").alias("m"))
    n1, n2, mm = (F.col(c).cast("double") for c in ("n1", "n2", "m"))
    half = 1.96 * F.sqrt(K.chapman_variance(n1, n2, mm))
    e = m.withColumn("estimate", K.chapman(n1, n2, mm)).withColumn("half", half)
    return e.select("s1", "s2", "n1", "n2", "m", "estimate", F.greatest(F.col("estimate") - F.col("half"), F.col("n1") + F.col("n2") - F.col("m")).alias("low"), (F.col("estimate") + F.col("half")).alias("high"))


def iceberg_summary(seen: DataFrame) -> DataFrame:
    observed = seen.agg(F.count_distinct("entity").alias("observed"))
    e = iceberg(seen).agg(F.percentile("estimate", 0.5).alias("estimate"), F.count("*").alias("pairs"))
    return e.crossJoin(F.broadcast(observed)).select("observed", "pairs", F.greatest("estimate", F.col("observed").cast("double")).alias("estimate"), (F.greatest("estimate", F.col("observed").cast("double")) - F.col("observed")).alias("dark"), (F.col("observed") / F.greatest("estimate", F.col("observed").cast("double"))).alias("visible"))


def communities(edges: DataFrame, of: DataFrame, scores: DataFrame, most: int = 6) -> DataFrame:
    """(community, size, internal, density, mean, accused, leader, top, suspicious)."""
    x, y = of.select(F.col("id").alias("a"), F.col("community").alias("ca")), of.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = edges.join(x, "a").join(y, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("internal"))
    m = of.join(scores, "id", "left")
    g = m.groupBy("community").agg(F.count("*").alias("size"), F.avg(F.coalesce("suspicion", F.lit(0.0))).alias("mean"), F.count_if(F.coalesce("accused", F.lit(0)) > 0).alias("accused"))
    top = top_per_group(m, ["community"], [F.desc_nulls_last("priority"), F.col("id")], most).groupBy("community").agg(F.min_by("id", "rank").alias("leader"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda s: s["id"]), ",").alias("top"))
    out = g.join(inside, "community", "left").join(top, "community").na.fill(0, ["internal"])
    dense = F.when(F.col("size") > 1, 2 * F.col("internal") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    return out.withColumns({"density": dense, "suspicious": (F.col("size") >= 3) & ((F.col("mean") >= 0.2) | ((F.col("mean") > 0.12) & (F.col("accused") >= 3)))})


def brokers(edges: DataFrame, of: DataFrame, scores: DataFrame, k: int = 8) -> DataFrame:
    """(id, span, score): nodes whose neighbours are in two communities or more, by betweenness x span x (1 + suspicion)."""
    span = both_ways(edges, "a", "b").join(of.select(F.col("id").alias("v"), "community"), "v").groupBy(F.col("u").alias("id")).agg(F.count_distinct("community").alias("span"))
    x = span.join(scores, "id").where("span >= 2 and betweenness > 0")
    return x.withColumn("score", F.col("betweenness") * F.col("span") * (1 + F.col("suspicion"))).orderBy(F.desc("score"), "id").limit(k).select("id", "span", "score")


def two_pass(score_actors, detect, signals: DataFrame) -> DataFrame:
    """Scores without anomalies, detectors over them, then scores with the anomalies found: structure is computed once."""
    first = score_actors(signals.withColumn("anomaly", F.lit(0.0)))
    from .detectors import anomaly_hits

    hits = anomaly_hits(detect(first))
    return score_actors(signals.join(hits, "id", "left").na.fill(0.0, ["anomaly"]))
