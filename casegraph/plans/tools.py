"""The tool registry: named, described functions over a case, for callers that choose by name. Table-valued extractors are also SQL
table functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeResult

from ..operators import graph as G
from ..operators import relational as R
from . import dossier as D


@dataclass
class Tool:
    name: str
    about: str
    parameters: dict[str, str]
    run: Callable[..., DataFrame]


TOOLS: dict[str, Tool] = {}


def tool(about: str, **parameters: str):
    def add(f):
        TOOLS[f.__name__] = Tool(f.__name__, about, parameters, f)
        return f

    return add


def call(name: str, case: D.Case, **arguments) -> DataFrame:
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}")
    unknown = set(arguments) - set(TOOLS[name].parameters)
    if unknown:
        raise ValueError(f"{name} takes no {', '.join(sorted(unknown))}")
    return TOOLS[name].run(case, **arguments)


@tool("Entities by name, alias or number", text="string", limit="integer")
def search_entities(case: D.Case, text: str, limit: int = 20) -> DataFrame:
    from .search import find

    return find(case.entities, text, limit)


@tool("The profile of an entity", entity="string")
def entity_profile(case: D.Case, entity: str) -> DataFrame:
    return case.entities.where(F.col("id") == entity)


@tool("Up to three shortest paths between two entities", source="string", target="string")
def find_path(case: D.Case, source: str, target: str) -> DataFrame:
    e = case.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    return G.paths(e, source, target)


@tool("Neighbours by weight", entity="string", limit="integer")
def neighbours(case: D.Case, entity: str, limit: int = 40) -> DataFrame:
    return D.dossier(case, entity)["associates"].limit(limit)


@tool("Money in and out by counterparty", entity="string")
def money_flow(case: D.Case, entity: str) -> DataFrame:
    return R.in_out(case.edges.where("rel_type = 'TRANSFERRED_TO'").withColumnRenamed("total_amount", "amount"), "subject").where(F.col("subject") == entity)


@tool("Events of an entity in time order", entity="string", last="integer")
def entity_timeline(case: D.Case, entity: str, last: int = 120) -> DataFrame:
    return D.timeline(case, entity, last)


@tool("The highest alerts", kind="string", limit="integer")
def list_alerts(case: D.Case, kind: str | None = None, limit: int = 20) -> DataFrame:
    a = case.alerts if kind is None else case.alerts.where(F.col("kind") == kind)
    return a.orderBy(F.desc("score"), "title").limit(limit)


@tool("Counts, sums or means by a column or time bucket", dataset="string", group_by="string", metric="string", value="string", limit="integer")
def aggregate(case: D.Case, dataset: str, group_by: str, metric: str = "count", value: str | None = None, limit: int = 50) -> DataFrame:
    df = getattr(case, dataset)
    group = R.BUCKETS[group_by](F.col("occurred_at")) if group_by in R.BUCKETS else group_by
    return R.aggregate_by(df, group, metric, value, limit=limit)


@tool("Documents that mention a text", text="string", limit="integer")
def search_documents(case: D.Case, text: str, limit: int = 20) -> DataFrame:
    hit = F.lower("content").contains(text.lower()) | F.lower("title").contains(text.lower())
    return case.documents.where(hit).orderBy("id").limit(limit)


@tool("One document", document="string")
def read_document(case: D.Case, document: str) -> DataFrame:
    return case.documents.where(F.col("id") == document)


@tool("Counts of entities by type")
def network_overview(case: D.Case) -> DataFrame:
    return R.aggregate_by(case.entities, "type")


class MentionTable:
    """SQL: select * from mentions_of('text')."""

    def eval(self, text: str):
        from .extract import Dictionary, mentions_in

        for m in mentions_in(text or "", Dictionary()):
            yield m["type"], m["text"], m["rule"], m["start"], m["end"], m["confidence"]


class LabelTable:
    """SQL: select * from labelled(table(t) partition by key order by ..., text => 'column', labels => 'WEAPON: knife, pistol; PLACE: station').

    The table has the partitioning columns and the text. One row a partition: the partitioning columns, `rows`, and for each label a column with the number of its words' occurrences (whole
    words, in either case). The labels are the caller's, so the columns differ from query to query; a fault in them is an error of analysis."""

    def __init__(self, result):
        self.text, self.words, self.keys = result.text, result.words, result.keys
        self.key, self.rows, self.counts = None, 0, None

    @staticmethod
    def analyze(table, text, labels):
        from pyspark.sql.types import IntegerType, StructType

        if not table.isTable or text.value is None or labels.value is None:
            raise ValueError("labelled(TABLE(...), text => 'column', labels => 'LABEL: word, word; ...') takes a table and two constants")
        if text.value not in table.dataType.names:
            raise ValueError(f"the table has no column {text.value}")
        words = {}
        for part in filter(str.strip, labels.value.split(";")):
            name, _, listed = part.partition(":")
            words[name.strip()] = [w.strip() for w in listed.split(",") if w.strip()]
        taken = [n.lower() for n in (*(f for f in table.dataType.names if f != text.value), "rows")]
        if not words or any(not n or not w or n.lower() in taken for n, w in words.items()):
            raise ValueError("each label has a name that is no column of the table, and a word")
        schema = StructType([f for f in table.dataType.fields if f.name != text.value]).add("rows", IntegerType())
        for name in words:
            schema = schema.add(name, IntegerType())
        keys = [f for f in table.dataType.names if f != text.value]
        return _LabelResult(schema=schema, text=text.value, words=words, keys=keys)

    def eval(self, row, text, labels):
        import re

        if self.counts is None:
            self.patterns = [re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + r")(?!\w)", re.I) for w in self.words.values()]
            self.counts = [0] * len(self.patterns)
        self.key = tuple(row[k] for k in self.keys)
        self.rows += 1
        for i, p in enumerate(self.patterns):
            self.counts[i] += len(p.findall(row[self.text] or ""))

    def terminate(self):
        if self.counts is not None:
            yield (*self.key, self.rows, *self.counts)


@dataclass
class _LabelResult(AnalyzeResult):
    text: str = ""
    words: dict = field(default_factory=dict)
    keys: list = field(default_factory=list)


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("mentions_of", F.udtf(MentionTable, returnType="type string, text string, rule string, start int, end int, confidence double"))
    spark.udtf.register("labelled", F.udtf(LabelTable))


# --- records that users keep ---


def patched(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts with the review status of changes (id, review_status)."""
    c = changes.select("id", F.col("review_status").alias("_new"))
    return alerts.join(c, "id", "left").withColumn("review_status", F.coalesce("_new", "review_status")).drop("_new")


def pending_entities(alerts: DataFrame) -> DataFrame:
    """Entities of any unreviewed alert of severity high or critical: their labels are held back."""
    a = alerts.where("review_status = 'pending' and severity in ('high', 'critical')")
    return a.select(F.explode("entity_ids").alias("id")).distinct()


def held_back(entities: DataFrame, alerts: DataFrame) -> DataFrame:
    p = pending_entities(alerts).withColumn("_p", F.lit(True))
    return entities.join(p, "id", "left").withColumn("label", F.when(F.col("_p"), "Pending analyst review").otherwise(F.col("label"))).drop("_p")


def provenance(source_type, url, title):
    """One line on where a record comes from."""
    name = F.coalesce(*(F.when(source_type == k, v) for k, v in {"FIR": "First information report", "CDR": "Call records", "TRANSACTION": "Bank transactions", "KYC": "Subscriber records", "SURVEILLANCE": "Surveillance report", "INTEL": "Intelligence report", "SOCIAL": "Social media", "NEWS": "News", "JUDGMENT": "Court judgment"}.items()), F.initcap(F.replace(source_type, F.lit("_"), F.lit(" "))))
    where = F.coalesce(F.nullif(F.regexp_extract(url, r"://(?:www\.)?([^/?#]+)", 1), F.lit("")), F.lit(""))
    return F.concat_ws(" - ", name, F.nullif(F.trim(title), F.lit("")), F.nullif(where, F.lit("")))
