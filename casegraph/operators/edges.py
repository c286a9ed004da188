"""Edge accumulation and the actor projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACTOR_TYPES, DIRECT_WEIGHTS, OWNERSHIP, SYMMETRIC

MONEY = "decimal(38,4)"


def canonical_ends(obs: DataFrame, src: str = "src", dst: str = "dst", rel: str = "rel_type", symmetric: tuple[str, ...] = SYMMETRIC) -> DataFrame:
    """Drops self-loops and null ends; symmetric relations get their ends in order."""
    sym = F.col(rel).isin(*symmetric)
    a, b = F.when(sym, F.least(src, dst)).otherwise(F.col(src)), F.when(sym, F.greatest(src, dst)).otherwise(F.col(dst))
    return obs.where(F.col(src) != F.col(dst)).withColumns({src: a, dst: b})


def accumulate(obs: DataFrame) -> DataFrame:
    """One edge per (src, dst, rel_type) from observations (src, dst, rel_type, weight, at, confidence, amount, duration, night,
    attr, order): sums, counts and bounds are partial aggregates; the first attribute by `order` wins, so arrival order
    does not matter."""
    o = canonical_ends(obs)
    return o.groupBy("src", "dst", "rel_type").agg(
        F.sum(F.coalesce(F.col("weight"), F.lit(1.0)).cast(MONEY)).cast("double").alias("weight"),
        F.count("*").alias("count"),
        F.max("confidence").alias("confidence"),
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.sum(F.col("amount").cast(MONEY)).cast("double").alias("total_amount"),
        F.max("amount").alias("max_amount"),
        F.sum("duration").alias("total_duration"),
        F.sum(F.col("night").cast("long")).alias("night_count"),
        F.min_by("attr", "order").alias("attr"),
    )


def merged(stored: DataFrame, partial: DataFrame) -> DataFrame:
    """Stored edges and a partial batch as one: add sums, widen bounds, keep the stored attribute where there is one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(partial.withColumn("_new", F.lit(1)))
    return both.groupBy("src", "dst", "rel_type").agg(
        F.sum(F.col("weight").cast(MONEY)).cast("double").alias("weight"),
        F.sum("count").alias("count"),
        F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum(F.col("total_amount").cast(MONEY)).cast("double").alias("total_amount"),
        F.max("max_amount").alias("max_amount"),
        F.sum("total_duration").alias("total_duration"),
        F.sum("night_count").alias("night_count"),
        F.min_by("attr", F.when(F.col("attr").isNotNull(), F.col("_new"))).alias("attr"),
    )


def evidence(obs: DataFrame, most: int = 12) -> DataFrame:
    """The first `most` observations of each edge by (order): the evidence kept with it."""
    from pyspark.sql import Window

    w = Window.partitionBy("src", "dst", "rel_type").orderBy("order")
    return canonical_ends(obs).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def collapsed(edges: DataFrame) -> DataFrame:
    """The undirected graph: one row per unordered pair, a stored 0 counts as 1, relation types as a sorted list."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    one = lambda c: F.when(F.col(c).isNull() | (F.col(c) == 0), 1).otherwise(F.col(c))
    return edges.where("src <> dst").groupBy(a, b).agg(F.sum(one("weight").cast(MONEY)).cast("double").alias("weight"), F.sum(one("count")).cast("long").alias("count"), F.concat_ws(",", F.array_sort(F.collect_set("rel_type"))).alias("rel_types"))


def both_ways(edges: DataFrame, a: str = "a", b: str = "b", *rest: str) -> DataFrame:
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v"), *rest).unionAll(edges.select(F.col(b).alias("u"), F.col(a).alias("v"), *rest))


def direct_weight(rel: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in DIRECT_WEIGHTS.items():
        out = F.when(rel == name, w).otherwise(out)
    return out


def transfer_weight(amount: Column, count: Column) -> Column:
    return F.log10(F.greatest(amount, F.lit(10.0))) * F.sqrt(count) / 2


def folded(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Proxy edges on the proxies' owners: every owner of one end with every owner of the other. owners: (proxy, owner)."""
    o1, o2 = owners.select(F.col("proxy").alias("src"), F.col("owner").alias("a")), owners.select(F.col("proxy").alias("dst"), F.col("owner").alias("b"))
    return edges.join(o1, "src").join(o2, "dst").where("a <> b")


def co_members(members: DataFrame, group: str, member: str, most: int = 30) -> DataFrame:
    """Pairs a < b of members of one group, one row per group; groups of more than `most` members say nothing and are skipped
    (this bounds a group's pairs). The size comes from an aggregate that is joined back, not from a gathered list."""
    m = members.select(F.col(group).alias("grp"), F.col(member).alias("m")).distinct()
    small = m.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("grp")
    m = m.join(small, "grp")
    return m.withColumnRenamed("m", "a").join(m.withColumnRenamed("m", "b"), "grp").where("a < b")


def projection(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The actor graph (a, b, weight, calls, night_calls, amount, channels) of persons and organisations that are no banks.
    Phones, accounts, handles and vehicles are folded onto their owners; channels: name=count, sorted."""
    actors = entities.where(F.col("type").isin(*ACTOR_TYPES) & ~((F.col("type") == "ORGANIZATION") & F.lower("label").rlike(r"\bbank\b"))).select("id")
    owners = edges.where(F.col("rel_type").isin(*OWNERSHIP)).select(F.col("dst").alias("proxy"), F.col("src").alias("owner")).distinct()
    proxy = folded(edges.where(F.col("rel_type").isin("CALLED", "TRANSFERRED_TO", "MENTIONED", "SHARED_HANDSET")), owners)
    rel = F.col("rel_type")
    weight = F.when(rel == "CALLED", F.sqrt("count")).when(rel == "TRANSFERRED_TO", transfer_weight(F.coalesce("total_amount", F.lit(0.0)), F.col("count"))).when(rel == "SHARED_HANDSET", 4.0).otherwise(1.0)
    channel = F.when(rel == "CALLED", "calls").when(rel == "TRANSFERRED_TO", "transfers").when(rel == "MENTIONED", "social").otherwise("shared_handset")
    calls = F.when(rel == "CALLED", F.col("count")).otherwise(0)
    night = F.when(rel == "CALLED", F.coalesce("night_count", F.lit(0))).otherwise(0)
    amount = F.when(rel == "TRANSFERRED_TO", F.coalesce("total_amount", F.lit(0.0))).otherwise(0.0)
    parts = proxy.select("a", "b", weight.alias("w"), channel.alias("channel"), calls.alias("calls"), night.alias("night"), amount.alias("amount"))
    direct = edges.where(direct_weight(rel).isNotNull()).select(F.col("src").alias("a"), F.col("dst").alias("b"), (direct_weight(rel) * F.col("count")).alias("w"), F.lower(rel).alias("channel"), F.lit(0), F.lit(0), F.lit(0.0))
    shared = co_members(edges.where(rel.isin("ACCUSED_IN", "COMPLAINANT_IN", "MENTIONED_IN")).join(actors, F.col("src") == actors.id, "left_semi"), "dst", "src").select("a", "b", F.lit(1.0), F.lit("shared_case"), F.lit(0), F.lit(0), F.lit(0.0))
    parts = parts.unionAll(direct).unionAll(shared).where("a <> b")
    for end in ("a", "b"):
        parts = parts.join(actors.withColumnRenamed("id", end), end, "left_semi")
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    per = parts.groupBy(*ends, "channel").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("night").alias("night"), F.sum("amount").alias("amount"))
    return per.groupBy("a", "b").agg(
        F.sum("w").alias("weight"), F.sum("calls").cast("long").alias("calls"), F.sum("night").cast("long").alias("night_calls"), F.sum("amount").alias("amount"), F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "channel", "n")))).alias("channels")
    )  # a pair has few channels, so this list is short


def foreign_contacts(uses: DataFrame, calls: DataFrame, foreign: DataFrame) -> DataFrame:
    """(person, contacts): calls between the phones that a person uses (person, phone) and foreign phones (phone), in either direction; calls
    (a, b, n). Persons without any are left out. Both joins are by phone; calls are first summed by pair."""
    both = calls.groupBy("a", "b").agg(F.sum("n").alias("n"))
    arcs = both.select(F.col("a").alias("phone"), F.col("b").alias("other"), "n").union(both.select(F.col("b").alias("phone"), F.col("a").alias("other"), "n"))
    hit = arcs.join(foreign.select(F.col("phone").alias("other")).distinct(), "other", "left_semi").groupBy("phone").agg(F.sum("n").alias("n"))
    return uses.select("person", "phone").distinct().join(hit, "phone").groupBy("person").agg(F.sum("n").alias("contacts"))
