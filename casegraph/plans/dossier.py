"""Composed queries: dossier, views, geo layer, the grouped tool, the router of plain questions, and the written brief."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import graph as G
from ..operators import relational as R
from ..operators.edges import both_ways


@dataclass
class Case:
    """The tables that the queries read."""

    entities: DataFrame
    edges: DataFrame
    events: DataFrame
    alerts: DataFrame
    evidence: DataFrame
    documents: DataFrame


def timeline(case: Case, entity: str, last: int = 120) -> DataFrame:
    rows = case.events.where(F.array_contains("entity_ids", entity)).orderBy(F.desc("occurred_at"), "id").limit(last)
    return rows.orderBy("occurred_at", "id")


def dossier(case: Case, entity: str) -> dict[str, DataFrame]:
    """Relationships by type, associates (40), evidence (60), alerts, timeline, weekly activity and documents of one entity."""
    e = case.edges.where((F.col("src") == entity) | (F.col("dst") == entity)).withColumn("other", F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src")))
    events = case.events.where(F.array_contains("entity_ids", entity))
    evidence = case.evidence.where(F.col("entity_id") == entity)
    return {
        "profile": case.entities.where(F.col("id") == entity), "relationships": e.groupBy("rel_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "associates": e.groupBy("other").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "other").limit(40),
        "evidence": evidence.orderBy(F.desc("confidence"), "id").limit(60), "alerts": case.alerts.where(F.array_contains("entity_ids", entity)).orderBy(F.desc("score"), "title"), "timeline": timeline(case, entity), "weekly": R.aggregate_by(events, R.BUCKETS["week"](F.col("occurred_at"))),
        "documents": case.documents.join(evidence.select(F.col("document_id").alias("id")), "id", "left_semi"),
    }


def timeline_view(case: Case, kinds: list[str] | None = None, start=None, end=None, poi: DataFrame | None = None, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The latest events and the day x kind histogram of all that match."""
    e = case.events
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    if start is not None:
        e = e.where(F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        e = e.where(F.col("occurred_at") <= F.lit(end).cast("timestamp_ntz"))
    if poi is not None:
        hit = e.select("id", F.explode("entity_ids").alias("e")).join(poi.select(F.col("id").alias("e")), "e", "left_semi").select("id").distinct()
        e = e.join(hit, "id", "left_semi")
    return e.orderBy(F.desc("occurred_at"), "id").limit(limit), e.groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("bucket"), "kind").agg(F.count("*").alias("n"))


def graph_view(edges: DataFrame, scores: DataFrame, limit: int = 200, most_edges: int = 6000) -> tuple[DataFrame, DataFrame]:
    """The most relevant actors and the heaviest edges between them."""
    d = G.degrees(edges)
    relevance = F.coalesce("priority", F.lit(0.0)) * 10 + F.coalesce("pagerank", F.lit(0.0)) * 100 + 0.02 * F.coalesce("degree", F.lit(0))
    nodes = scores.join(d, "id", "left").withColumn("relevance", relevance).orderBy(F.desc("relevance"), "id").limit(limit)
    inside = edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    return nodes, inside.orderBy(F.desc("weight"), "a", "b").limit(most_edges)


def projection_view(edges: DataFrame, scores: DataFrame, least_weight: float = 0.0, only_poi: bool = False) -> DataFrame:
    e = edges.where(F.col("weight") >= least_weight)
    if not only_poi:
        return e
    poi = scores.where("suspicion >= 0.2").select(F.col("id").alias("u"))
    ends = both_ways(e, "a", "b").join(poi, "u", "left_semi").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return e.join(ends, ["a", "b"], "left_semi")


def geo_layer(case: Case, scores: DataFrame, places: tuple[str, ...] = ("SEEN_AT", "RESIDES_AT", "PINGED_AT", "LOCATED_AT")) -> DataFrame:
    """(place, actors, poi, mean, threat)."""
    e = case.edges.where(F.col("rel_type").isin(*places)).join(scores.select(F.col("id").alias("src"), "suspicion"), "src", "left")
    g = e.groupBy(F.col("dst").alias("place")).agg(F.count_distinct("src").alias("actors"), F.count_if(F.col("suspicion") >= 0.2).alias("poi"), F.avg(F.coalesce("suspicion", F.lit(0.0))).alias("mean"))
    return g.withColumn("threat", K.tier(F.least(F.lit(1.0), F.col("mean") + 0.1 * F.col("poi"))))


# --- plain questions ---

# Words that select an intent, in the order in which they are tried.
INTENTS = (("path", r"\b(path|connect(?:ed|ion)?|link between|how .* related)\b"), ("money", r"\b(money|transfer|transaction|payment|fund)s?\b"), ("calls", r"\b(call|phone pattern|call record)s?\b"), ("timeline", r"\b(timeline|when|chronolog)"), ("alerts", r"\b(alert|anomal|suspicious pattern)"), ("communities", r"\b(communit|gang|cluster|group)"), ("key_players", r"\b(key player|leader|kingpin|most important|top suspect)"), ("predict", r"\b(predict|hidden link|likely link)"), ("disruption", r"\b(disrupt|remove|arrest .* impact|take out)"), ("documents", r"\b(document|report|fir|mention)s?\b"), ("overview", r"\b(overview|summary|network|how many)\b"), ("profile", r"\b(who is|profile|about|tell me)\b"))


def intent(question: str) -> str:
    q = question.lower()
    return next((name for name, p in INTENTS if re.search(p, q)), "search")


def spotted(question: str) -> list[str]:
    """Plates, phones, quoted and capitalised names in a question, in that order."""
    plates = re.findall(r"\b[A-Z]{2}[ -]?\d{1,2}[ -]?[A-Z]{1,3}[ -]?\d{4}\b", question)
    phones = re.findall(r"(?<!\d)\d{10,12}(?!\d)", question)
    quoted = re.findall(r"[\"']([^\"']{2,60})[\"']", question)
    names = [m for m in re.findall(r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)+\b", question)]
    return list(dict.fromkeys([*plates, *phones, *quoted, *names]))


def answer(case: Case, question: str, actors: DataFrame | None = None, scores: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(intent, rows): the deterministic router. actors: projection edges (a, b, weight)."""
    from .search import find

    what, names = intent(question), spotted(question)
    ids = [r["id"] for n in names for r in find(case.entities, n, 1).collect()]
    if what == "path" and len(ids) >= 2 and actors is not None:
        return what, G.paths(actors, ids[0], ids[1])
    if what == "money":
        flow = R.in_out(case.edges.where("rel_type = 'TRANSFERRED_TO'").withColumnRenamed("total_amount", "amount"), "subject")
        return what, flow.where(F.col("subject").isin(*ids)) if ids else flow.orderBy(F.desc("money_out"), "subject", "counterparty").limit(20)
    if what == "timeline" and ids:
        return what, timeline(case, ids[0])
    if what == "alerts":
        return what, case.alerts.orderBy(F.desc("score"), "title").limit(20)
    if what == "key_players" and scores is not None:
        from .scoring import key_players

        return what, key_players(scores)
    if what == "predict" and actors is not None:
        return what, G.two_hop(actors).orderBy(F.desc("adamic_adar"), "a", "b").limit(20)
    if what == "overview":
        return what, R.aggregate_by(case.entities, "type")
    if what == "documents":
        needle = names[0] if names else question
        return what, case.documents.where(F.lower("content").contains(needle.lower()) | F.lower("title").contains(needle.lower())).orderBy("id").limit(20)
    return "search", find(case.entities, names[0] if names else question)


# --- the brief ---


def masked(text: str, protected: dict[str, str]) -> str:
    """Protected names (name -> role) become [ROLE], the longest first, at word ends."""
    for name in sorted(protected, key=lambda n: (-len(n), n)):
        text = re.sub(rf"\b{re.escape(name)}\b", f"[{protected[name].upper()}]", text, flags=re.I)
    return text


def brief(title: str, parts: dict[str, DataFrame], protected: dict[str, str], most: int = 20) -> str:
    """Markdown: a section for each table with up to `most` rows; a seal of the text's hash at the end."""
    from .ledger import digest

    out = [f"# {title}"]
    for name, df in parts.items():
        rows = df.limit(most).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "/") if v is not None else "" for v in r) + " |" for r in rows] or ["(none)"]
    text = masked("\n".join(out), protected)
    return f"{text}\n\nSeal: {digest(text)}\n"
