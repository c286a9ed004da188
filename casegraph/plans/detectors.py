"""Pattern detectors: event and edge tables to scored rows; a registry isolates failures; alerts are kept by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import windows as W
from ..operators.store import written

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def _capped(x: Column, top: float = 1.0) -> Column:
    return F.least(F.lit(top), x)


@register("burner_phone")
def burners(calls: DataFrame, least: int = 8, most_days: int = 14, attributed: Column | None = None) -> DataFrame:
    """(phone, n, span, score) from (phone, ts) of unverified national phones: many calls in a short life. `attributed`: does the
    best candidate owner score above .2?"""
    s = calls.groupBy("phone").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    span = (F.floor((W.epoch("z") - W.epoch("a")) / 86400) + 1).cast("long")
    bonus = F.when(attributed, 0.3).otherwise(0.1) if attributed is not None else F.lit(0.1)
    return s.withColumn("span", span).where((F.col("n") >= least) & (F.col("span") <= most_days)).withColumn("score", _capped(0.5 + 0.03 * F.col("n") / F.col("span") + bonus)).drop("a", "z")


def burner_attribution(burner_calls: DataFrame, person_calls: DataFrame, handsets: DataFrame) -> DataFrame:
    """(phone, person, score): the likely user of each burner. burner_calls: (phone, contact, tower); person_calls: (person, contact,
    tower); handsets: (phone, person) that share a device, score 1. Else .6 contact overlap + .4 tower histogram overlap; candidates
    are only those with a contact or tower in common, which an equi-join finds, and scores above .15 are kept."""
    b, p = burner_calls.select("phone", "contact").distinct(), person_calls.select("person", "contact").distinct()
    nb, np_ = b.groupBy("phone").agg(F.count("*").alias("nb")), p.groupBy("person").agg(F.count("*").alias("np"))
    common = b.join(p, "contact").groupBy("phone", "person").agg(F.count("*").alias("c"))
    overlap = common.join(nb, "phone").join(np_, "person").select("phone", "person", (F.col("c") / F.greatest(F.col("nb") + F.col("np") - F.col("c"), F.lit(1))).alias("overlap"))
    share = lambda df, k: df.groupBy(k, "tower").agg(F.count("*").alias("n")).join(df.groupBy(k).agg(F.count("*").alias("all")), k).select(k, "tower", (F.col("n") / F.col("all")).alias(f"s_{k}"))
    towers = share(burner_calls, "phone").join(share(person_calls, "person"), "tower").groupBy("phone", "person").agg(F.sum(F.least("s_phone", "s_person")).alias("towers"))
    scored = overlap.join(towers, ["phone", "person"], "full").select("phone", "person", (0.6 * F.coalesce("overlap", F.lit(0.0)) + 0.4 * F.coalesce("towers", F.lit(0.0))).alias("score"))
    every = scored.unionAll(handsets.select("phone", "person", F.lit(1.0)))
    return every.where("score > 0.15").groupBy("phone").agg(F.max_by(F.struct("person", "score"), F.struct("score", F.col("person"))).alias("x")).select("phone", "x.person", "x.score")


@register("call_burst")
def call_bursts(calls: DataFrame, least_z: float = 3.0, least: int = 12, least_total: int = 50) -> DataFrame:
    """(hour, v, score): six-hour windows far above the mean, greedily apart."""
    b = W.rolling_bursts(calls).where((F.col("z") >= least_z) & (F.col("v") >= least) & (F.col("total") >= least_total)).withColumn("g", F.lit(0))
    return W.suppressed(b, ["g"]).join(b, ["g", "hour"]).select("hour", "v", "z", _capped(0.45 + 0.08 * F.col("z")).alias("score"))


@register("structuring")
def structuring(credits: DataFrame, onward: DataFrame, limit: float = 50_000.0) -> DataFrame:
    """(account, start, n, onward, score) from (account, ts, amount): at least three credits just below the limit in 72 hours;
    `onward` (account, ts, id, value): transfers out, the largest within 96 hours of the last counts."""
    near = credits.where((F.col("amount") >= 0.85 * limit) & (F.col("amount") < limit))
    w = W.anchored_count(near, "account")
    out = onward.select("account", W.epoch("ts").alias("t"), "value")
    j = w.join(out, "account", "left").groupBy("account", "start", "n").agg(F.max(F.when((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("start") + (72 + 96) * 3600), F.col("value"))).alias("onward"))
    return j.withColumn("score", _capped(0.55 + 0.05 * F.col("n") + F.when(F.col("onward").isNotNull(), 0.2).otherwise(0.0)))


@register("layering")
def layering(transfers: DataFrame) -> DataFrame:
    r = W.routes(W.chains(transfers))
    return r.withColumn("score", _capped(0.6 + 0.1 * (F.col("hops") - 2) + F.when(F.col("retained") > 0.6, 0.1).otherwise(0.0) + F.when(F.col("runs") > 1, 0.05).otherwise(0.0)))


def transfer_concentration(incoming: DataFrame, least: int = 6, least_window: int = 4, least_senders: int = 3, least_share: float = 0.8) -> DataFrame:
    """(account, n, senders, share, day, total) from (account, sender, amount, ts): most of what came in came within five days."""
    b = W.best_days(incoming, "account", "amount")
    a = incoming.groupBy("account").agg(F.sum(F.col("amount").cast("decimal(38,4)")).cast("double").alias("total_in"), F.count("*").alias("c"), F.count_distinct("sender").alias("senders"))
    j = b.join(a, "account").withColumn("share", F.col("total") / F.col("total_in"))
    return j.where((F.col("c") >= least) & (F.col("n") >= least_window) & (F.col("senders") >= least_senders) & (F.col("share") >= least_share))


@register("transfer_burst")
def transfer_bursts(incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    """Concentration whose money also left: outgoing (account, ts, amount) from the window's first day to 96 hours after its end."""
    c = transfer_concentration(incoming)
    first = F.col("day") * 86400
    out = c.join(outgoing.select("account", W.epoch("ts").alias("t"), F.col("amount").alias("o")), "account", "left")
    passed = out.groupBy(*c.columns).agg(F.coalesce(F.sum(F.when((F.col("t") >= first) & (F.col("t") <= first + 9 * 86400), F.col("o"))), F.lit(0.0)).alias("out")).withColumn("passed", F.col("out") / F.col("total"))
    return passed.where("passed >= 0.6").withColumn("score", _capped(0.45 + 0.25 * F.col("share") + 0.2 * F.least("passed", F.lit(1.0)) + 0.1 * F.least(F.col("senders") / 6, F.lit(1.0))))


@register("complaint_hub")
def complaint_hubs(complaints: DataFrame, least: int = 3) -> DataFrame:
    """(account, n, cities, third, score) from (account, ts, id, city); third: when the third complaint came."""
    from ..operators.relational import top_per_group

    third = top_per_group(complaints, ["account"], [F.col("ts"), F.col("id")], 3).where("rank = 3").select("account", F.col("ts").alias("third"))
    n = complaints.groupBy("account").agg(F.count("*").alias("n"), F.count_distinct("city").alias("cities")).where(F.col("n") >= least)
    return n.join(third, "account", "left").withColumn("score", _capped(0.55 + 0.03 * F.least("n", F.lit(12)) + F.when(F.col("cities") >= 4, 0.1).otherwise(0.0)))


@register("night_activity")
def night_activity(calls: DataFrame, least: int = 15, least_ratio: float = 0.4) -> DataFrame:
    n = calls.groupBy("phone").agg(F.count("*").alias("n"), F.avg(K.is_night(F.col("ts")).cast("double")).alias("ratio"))
    return n.where((F.col("n") >= least) & (F.col("ratio") >= least_ratio)).withColumn("score", _capped(0.3 + F.col("ratio")))


@register("international_contact")
def international(calls: DataFrame) -> DataFrame:
    """From (phone, ts) of calls with an international number."""
    n = calls.groupBy("phone").agg(F.count("*").alias("n"), F.count_if(K.is_night(F.col("ts"))).alias("nights"))
    return n.withColumn("score", _capped(0.5 + 0.05 * F.col("n") + F.when(F.col("nights") > 0.5 * F.col("n"), 0.15).otherwise(0.0)))


def _count_score(df: DataFrame, by: str, base: float, step: float, top: float, least: int = 1) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("score", _capped(base + step * F.col("n"), top))


@register("wanted_corporate_ties")
def wanted_ties(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    corporate = edges.where(F.col("rel_type").isin("OWNS", "DIRECTOR_OF", "AFFILIATED_WITH", "CONTROLS"))
    return _count_score(corporate.join(wanted.select(F.col("id").alias("src")), "src", "left_semi"), "src", 0.7, 0.05, 0.95)


@register("offshore_officer_accused")
def offshore_accused(accused: DataFrame, offshore: DataFrame) -> DataFrame:
    return accused.select("id").distinct().join(offshore.select("id"), "id", "left_semi").withColumn("score", F.lit(0.75))


@register("debarred_shared_directors")
def debarred_shared(directors: DataFrame, debarred: DataFrame) -> DataFrame:
    """From DIRECTOR_OF (person, org): other organisations of a debarred one's directors."""
    d = directors.select("person", "org").distinct()
    x = d.join(debarred.select(F.col("id").alias("org")), "org", "left_semi").withColumnRenamed("org", "listed")
    pairs = x.join(d.withColumnRenamed("org", "other"), "person").where("listed <> other")
    return pairs.groupBy("listed", "other").agg(F.count("*").alias("n")).withColumn("score", _capped(0.5 + 0.05 * F.col("n"), 0.85))


@register("mass_directorship")
def mass_directorship(directors: DataFrame, least: int = 8) -> DataFrame:
    return _count_score(directors.select("person", "org").distinct(), "person", 0.35, 0.02, 0.7, least)


@register("ownership_conflict")
def ownership_conflicts(owners: DataFrame) -> DataFrame:
    """(asset, n, score) of assets with two owners or more."""
    n = owners.groupBy("asset").agg(F.count_distinct("owner").alias("n")).where("n >= 2")
    return n.withColumn("score", F.least(F.lit(0.95), 0.6 + 0.15 * (F.col("n") - 2)))


@register("attribute_conflict")
def attribute_conflicts(values: DataFrame) -> DataFrame:
    """(entity, attribute, n, score) where sources differ: (entity, attribute, value)."""
    n = values.where("value is not null").groupBy("entity", "attribute").agg(F.count_distinct(F.lower(F.trim("value"))).alias("n")).where("n >= 2")
    return n.withColumn("score", F.when(F.col("attribute").rlike("(?i)dob|birth"), 0.7).otherwise(0.5))


@register("status_conflict")
def status_conflicts(entities: DataFrame, edges: DataFrame, closed: tuple[str, ...] = ("dissolved", "struck off", "inactive", "deceased", "closed")) -> DataFrame:
    """Entities of a closed status that still have later activity."""
    e = entities.where(F.lower("status").isin(*closed))
    return e.join(edges.select(F.col("src").alias("id"), "last_seen").unionAll(edges.select("dst", "last_seen")), "id").where("last_seen > status_at").groupBy("id").agg(F.count("*").alias("n")).withColumn("score", F.lit(0.85))


@register("statement_contradiction")
def contradictions(statements: DataFrame, pings: DataFrame, km: float = 50.0) -> DataFrame:
    """Statements (id, person, day, lat, lon) whose person's phone was pinged (person, day, lat, lon) further than `km` away that day."""
    from ..functions.geo import haversine

    p = pings.select("person", "day", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    d = haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return statements.join(p, ["person", "day"]).withColumn("km", d).where(F.col("km") > km).groupBy("id", "person").agg(F.max("km").alias("km"), F.count("*").alias("n")).withColumn("severity", F.when(F.col("km") > 4 * km, "critical").otherwise("high"))


def denied_contacts(denials: DataFrame, edges: DataFrame) -> DataFrame:
    """Denials (id, a, b) that an edge contradicts."""
    e = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    return denials.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(e, ["x", "y"], "left_semi").drop("x", "y")


# --- alerts ---


def alerts(found: DataFrame, kind: str, entities: list[str], title: Column) -> DataFrame:
    """Scored rows as alerts; the id is a hash of the kind and the sorted entities, so a reworded title is the same alert."""
    ids = F.array_sort(F.array(*(F.col(c).cast("string") for c in entities)))
    return found.select(F.sha2(F.concat_ws("|", F.lit(kind), F.array_join(ids, ",")), 256).alias("id"), F.lit(kind).alias("kind"), K.severity(F.col("score")).alias("severity"), title.alias("title"), F.col("score"), ids.alias("entity_ids"))


def run_all(jobs: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """All alerts and the failures by name: a detector that fails, in analysis or at run time, becomes a detector_error alert of score
    .1 without entities and stops no other. Each detector's alerts are written as soon as it runs."""
    out, failed = None, {}
    for name, job in jobs.items():
        try:
            df = written(job(), "alerts")
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]
            df = _failure(name)
        out = df if out is None else out.unionByName(df)
    return out, failed


def _failure(name: str) -> DataFrame:
    """The detector_error alert of one detector; its id is a hash of the kind and the detector's name."""
    row = SparkSession.active().range(1).withColumns({"score": F.lit(0.1), "kind": F.lit("detector_error"), "title": F.lit(f"{name} failed")})
    return row.select(
        F.sha2(F.concat_ws("|", "kind", F.lit(name)), 256).alias("id"), "kind", K.severity(F.col("score")).alias("severity"), "title", "score",
        F.array().cast("array<string>").alias("entity_ids"),
    )


def persisted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: an analyst's status stays, stale alerts go only while open."""
    j = new.alias("n").join(stored.select("id", F.col("status").alias("old_status"), F.col("review_status").alias("old_review")), "id", "left")
    fresh = j.select("id", "kind", "severity", "title", "score", "entity_ids", F.coalesce("old_status", F.lit("open")).alias("status"), F.coalesce("old_review", F.lit("pending")).alias("review_status"))
    kept = stored.where("status <> 'open'").join(new, "id", "left_anti").select(*fresh.columns)
    return fresh.unionByName(kept)


def anomaly_hits(alerts_: DataFrame) -> DataFrame:
    """The largest alert score of each entity: what the second scoring pass takes in."""
    return alerts_.select(F.explode("entity_ids").alias("id"), "score").groupBy("id").agg(F.max("score").alias("anomaly"))
