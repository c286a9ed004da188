"""Entity resolution, screening and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.similarity import scored
from ..operators.components import components
from ..operators.edges import merged
from ..operators.store import written
from .names import similar


def exact(mentions: DataFrame) -> DataFrame:
    """Mentions (type, text, source, at, order, attributes) as entities by (type, canonical key): counts, time bounds, aliases; the first
    non-empty attribute in `order` wins."""
    m = mentions.withColumn("key", K.canonical_key(F.col("type"), F.col("text"))).where("key <> ''")
    return m.groupBy("type", "key").agg(F.sha2(F.concat_ws("|", F.first("type"), F.first("key")), 256).alias("id"), F.min_by("text", "order").alias("label"), F.count("*").alias("mention_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.array_sort(F.collect_set("text")).alias("aliases"))


def namesakes(mentions: DataFrame) -> DataFrame:
    """Short personal names of different sources are different persons: key#n by the order in which sources are first seen."""
    m = mentions.withColumn("key", K.canonical_key(F.col("type"), F.col("text")))
    first = m.groupBy("type", "key", "source").agg(F.min("order").alias("first"))
    n = F.row_number().over(Window.partitionBy("type", "key").orderBy("first", "source"))
    short = (F.col("type") == "PERSON") & (F.size(F.split("key", " ")) <= 2)
    first = first.withColumn("n", F.when(short, n).otherwise(1)).drop("first")
    return m.join(first, ["type", "key", "source"]).withColumn("key", F.when(F.col("n") > 1, F.concat_ws("#", "key", "n")).otherwise(F.col("key"))).drop("n")


def alias_resolved(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions whose text is an alias (alias, id) that names one entity only."""
    one = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    return mentions.withColumn("alias", F.lower(F.regexp_replace("text", r"(?i)\s+(bhai|seth|bhaiya|dada)$", ""))).join(one, "alias", "left").drop("alias")


def fuzzy(entities: DataFrame, least: float = 88.0) -> DataFrame:
    """(id, entity): persons whose keys agree by token set within a block. The block is (first letter, last token), as the rule asks
    for equal last tokens; both guards stand inside the pair test, before the transitive closure. A block's pairs are of distinct
    keys only. entities: (id, type, key, source)."""
    p = entities.where("type = 'PERSON'").select("id", "key", "source").withColumns({"first": F.substring("key", 1, 1), "last": F.element_at(F.split("key", " "), -1)})
    x, y = p.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("source").alias("sa"), "first", "last"), p.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("source").alias("sb"), "first", "last")
    pairs = x.join(y, ["first", "last"]).where((F.col("a") < F.col("b")) & (F.col("sa").eqNullSafe(F.col("sb"))) & (F.levenshtein("ka", "kb") <= F.greatest(F.length("ka"), F.length("kb"))))
    links = scored(pairs, "ka", "kb", "token_set").where(F.col("score") >= least).select("a", "b")
    of = components(links)
    return entities.join(of.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("entity"))


def contained_places(places: DataFrame, least: int = 5) -> DataFrame:
    """(id, parent): a place whose key begins with another place's key of at least five letters, by an equi-join on all prefixes at
    word ends; the longest parent wins."""
    w = F.split("key", " ")
    parts = places.select("id", "key", F.explode(F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.array_join(F.slice(w, 1, n), " "))).alias("prefix")).where((F.col("prefix") != F.col("key")) & (F.length("prefix") >= least))
    j = parts.join(places.select(F.col("id").alias("parent"), F.col("key").alias("prefix")), "prefix")
    return j.groupBy("id").agg(F.max_by("parent", F.struct(F.length("prefix"), "parent")).alias("parent"))


def _nameable() -> Column:
    """Names of seven characters or more, of persons with two words or more."""
    return (F.length("label") >= 7) & ((F.col("type") != "PERSON") | (F.size(F.split(F.trim("label"), r"\s+")) >= 2))


def screened(actors: DataFrame, listed: DataFrame, least_person: float = 88.0, least_org: float = 92.0) -> DataFrame:
    """(id, list_id, score, strong): the best watchlist name of each actor (id, type, label) among all names of any type; names under seven
    characters and persons of one token are skipped. Names meet in the index of names.similar(), so neither side is compared whole."""
    a = actors.where(_nameable()).select("id", "type", "label").distinct()
    found = similar(a.select("id", F.col("label").alias("name")), listed.select("id", "name"), min(least_person, least_org))
    s = found.select(F.col("a").alias("id"), F.col("la").alias("label"), F.col("b").alias("list_id"), "score").join(a, ["id", "label"])
    s = s.where(F.col("score") >= F.when(F.col("type") == "PERSON", least_person).otherwise(least_org))
    best = s.groupBy("id", "type", "label").agg(F.max_by(F.struct("list_id", "score"), F.struct("score", F.col("list_id"))).alias("x"))
    strong = ((F.size(F.split("label", r"\s+")) >= 3) & (F.col("x.score") >= 95)) | ((F.col("type") == "ORGANIZATION") & (F.col("x.score") >= 97))
    return best.select("id", "x.list_id", "x.score", strong.alias("strong"))


def proposed(listed: DataFrame, others: DataFrame, existing: DataFrame, least: float = 92.0, strong: float = 96.0, most: int = 3) -> DataFrame:
    """(a, b, score, strength): namesakes of watchlist rows among the other actors (id, type, label) of the same type, as proposals that a person
    has to confirm, never merges. Of each listed row the `most` best names (by score, then id) that reach `least`; pairs that `existing`
    (a, b) holds in either direction are left out. Names under seven characters and persons of one token are skipped."""
    x, y = (df.where(_nameable()).select("id", "type", "label").distinct() for df in (listed, others))
    s = similar(*(df.select("id", F.col("label").alias("name")) for df in (x, y)), least).where("a <> b")
    s = s.join(x.select(F.col("id").alias("a"), F.col("label").alias("la"), "type"), ["a", "la"]).join(y.select(F.col("id").alias("b"), F.col("label").alias("lb"), "type"), ["b", "lb", "type"])
    best = s.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("rank") <= most)
    known = existing.select("a", "b").union(existing.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return best.join(known, ["a", "b"], "left_anti").select("a", "b", "score", F.when(F.col("score") >= strong, "strong").otherwise("probable").alias("strength"))


def stamped(entities: DataFrame) -> DataFrame:
    """`entities` (type, label, court_role, ...) with standing in the record, non_subject and protected."""
    role = F.col("court_role")
    return entities.withColumns({"standing": K.standing(F.col("type"), F.col("label"), role), "non_subject": K.non_subject({"court_role": role}, F.col("label"), F.col("type")), "protected": K.protected_party({"court_role": role}, F.col("label"))})


def recall(names: DataFrame, least: float = 88.0) -> DataFrame:
    """Over pairs of names (a, b) of one entity: the shares that the exact key and the fuzzy rule unify."""
    s = scored(names, "a", "b", "token_set")
    return s.agg(F.count("*").alias("pairs"), F.avg((K.person_key(F.col("a")) == K.person_key(F.col("b"))).cast("double")).alias("exact"), F.avg((F.col("score") >= least).cast("double")).alias("fuzzy"))


# --- maintenance ---


def purge(entities: DataFrame, edges: DataFrame, evidence: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Without junk entities, and what hangs on them: edges, evidence, and their ids in events."""
    junk = written(entities.where(K.junk_mention(F.col("type"), F.col("label"))["junk"]).select("id"), "junk")
    gone = lambda df, c: df.join(junk.withColumnRenamed("id", c), c, "left_anti")
    ids = events.select("id", F.explode_outer("entity_ids").alias("entity"))
    left = gone(ids, "entity").groupBy("id").agg(F.array_sort(F.collect_list("entity")).alias("entity_ids"))
    kept = events.drop("entity_ids").join(left, "id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))
    return gone(entities, "id"), gone(gone(edges, "src"), "dst"), gone(evidence, "entity_id"), kept


def redirected(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after a merge of entities (id, into): ends redirected, duplicates combined, self-loops dropped."""
    for end in ("src", "dst"):
        m = mapping.select(F.col("id").alias(end), F.col("into"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
    edges = edges.where("src <> dst")
    return merged(edges, edges.limit(0))


def orphans(entities: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    used = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).unionAll(evidence.select("entity_id"))
    return entities.join(used, "id", "left_anti")


def dropped_sources(documents: DataFrame, evidence: DataFrame, entities: DataFrame, kinds: tuple[str, ...] = ("BENCHMARK", "STATS")) -> tuple[DataFrame, DataFrame]:
    """Documents of other kinds, and entities that are not cited only by the dropped ones."""
    out = documents.where(F.col("source_type").isin(*kinds)).select(F.col("id").alias("document_id"))
    here = evidence.join(out, "document_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    other = evidence.join(out, "document_id", "left_anti").select(F.col("entity_id").alias("id"))
    return documents.where(~F.col("source_type").isin(*kinds)), entities.join(here.join(other, "id", "left_anti"), "id", "left_anti")


def deduplicated_documents(documents: DataFrame) -> DataFrame:
    """Of documents with one title and source type, the one ingested first."""
    from ..operators.relational import keep_first

    return keep_first(documents, ["source_type", "title"], [F.col("ingested_at"), F.col("id")])


def thin_documents(documents: DataFrame, extracted: DataFrame, fetched: DataFrame, least: int = 400) -> DataFrame:
    """Documents worth another extraction: content under `least` characters, not extracted before, and a fetched text (id, text) that is
    longer. The content becomes the fetched text."""
    short = documents.where(F.coalesce(F.length("content"), F.lit(0)) < least).join(extracted.select("id"), "id", "left_anti")
    j = short.join(fetched.select("id", F.col("text").alias("_t")), "id").where(F.length("_t") > F.coalesce(F.length("content"), F.lit(0)))
    return j.withColumn("content", F.col("_t")).drop("_t")


def without_text_extraction(edges: DataFrame, evidence: DataFrame, kinds: tuple[str, ...] = ("rules", "gliner", "llm")) -> tuple[DataFrame, DataFrame]:
    """Edges and evidence that do not come from text alone: the state before an extraction is run anew. An edge stays if any of its
    evidence (relationship_id) is structured."""
    kept = evidence.where(~F.coalesce(F.col("extractor").isin(*kinds), F.lit(False)))
    only = evidence.select(F.col("relationship_id").alias("id")).dropna().distinct().join(kept.select(F.col("relationship_id").alias("id")), "id", "left_anti")
    return edges.join(only, "id", "left_anti"), kept


def merged_attributes(rows: DataFrame, key: str = "id", order: str = "order") -> DataFrame:
    """(key, attributes): of each attribute the first non-empty value by `order`; "Unverified" gives way to anything later."""
    each = rows.select(key, order, F.explode("attributes").alias("k", "v")).where("v is not null and trim(v) <> ''")
    best = each.groupBy(key, "k").agg(F.min_by("v", F.struct(F.lower("v") == "unverified", order)).alias("v"))
    return best.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
