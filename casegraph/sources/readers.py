"""Readers of the input kinds. Each gives documents, mentions, edge observations or events in the data model's shape."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.text import html_text

CONNECTORS: dict[str, Callable[..., DataFrame]] = {}


def connector(name: str):
    def add(f):
        CONNECTORS[name] = f
        return f

    return add


def read(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in CONNECTORS:
        raise ValueError(f"no source {name!r}; there are {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[name](spark, path, **options)


def harvest(spark: SparkSession, jobs: list[tuple[str, str]]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """All sources that can be read, and a (source, reason) for each that cannot: one failure stops no other."""
    out, failed = {}, []
    for name, path in jobs:
        try:
            df = read(spark, name, path)
            df.schema  # noqa: B018
            out[f"{name}:{path}"] = df
        except Exception as e:  # noqa: BLE001
            failed.append((name, str(e).splitlines()[0][:200]))
    return out, failed


@connector("csv")
def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by header."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@connector("json")
def json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


@connector("ndjson")
def ndjson(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    df = spark.read.option("mode", "DROPMALFORMED").json(path)
    return df.limit(limit) if limit else df


@connector("text")
def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("title"), F.col("value").alias("content"))


@connector("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


@connector("zip_csv")
def zip_csv(spark: SparkSession, path: str, member: str = "nodes.csv") -> DataFrame:
    """One CSV of each archive as (archive, row map); # goes from the headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    table = pd.read_csv(z.open(member), dtype=str, skipinitialspace=True)
                table.columns = [c.replace("#", "").strip() for c in table.columns]
                yield pd.DataFrame({"archive": name, "row": [{k: v for k, v in r.items() if isinstance(v, str)} for r in table.to_dict("records")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, row map<string,string>")


@connector("rss")
def rss(spark: SparkSession, path: str) -> DataFrame:
    """(title, description, link, published) of each item, markup stripped, 1500 characters at most."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), 1)).alias("i"))
    field = lambda tag: html_text(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    return x.select(field("title").alias("title"), F.substring(field("description"), 1, 1500).alias("description"), field("link").alias("link"), field("pubDate").alias("published"))


def html_names(pages: DataFrame, page_id: str = "page_id", html: str = "html", cues: tuple[str, ...] = ("wanted", "absconding", "proclaimed offender")) -> DataFrame:
    """(page_id, name, how): alternative texts of images, first cells of table rows, and capitalised names near cue words."""
    name = r"[A-Z][a-z]+(?:\s[A-Z][a-z]+){1,3}"
    alt = F.transform(F.regexp_extract_all(html, F.lit(rf'<img[^>]*alt="({name})"'), 1), lambda x: F.struct(x.alias("name"), F.lit("image").alias("how")))
    cell = F.transform(F.regexp_extract_all(html, F.lit(rf"(?s)<tr[^>]*>\s*<td[^>]*>\s*({name})\s*</td>"), 1), lambda x: F.struct(x.alias("name"), F.lit("table").alias("how")))
    prose = F.transform(F.regexp_extract_all(html_text(F.col(html)), F.lit(rf"(?:{'|'.join(cues)})\W+(?:\w+\W+){{0,3}}?({name})"), 1), lambda x: F.struct(x.alias("name"), F.lit("prose").alias("how")))
    return pages.select(page_id, F.explode(F.concat(alt, cell, prose)).alias("x")).select(page_id, "x.name", "x.how").distinct()


def search_results(pages: DataFrame, html: str = "html", preferred: tuple[str, ...] = ()) -> DataFrame:
    """(url, title, host): links of a result page, one per host, preferred hosts first."""
    links = F.regexp_extract_all(html, F.lit(r'<a[^>]*href="(https?://[^"]+)"[^>]*>(?:[^<]*)</a>'), 1)
    x = pages.select(F.posexplode(links).alias("pos", "url")).withColumn("host", F.regexp_replace(F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1)), "^www\\.", ""))
    rank = F.when(F.col("host").isin(*preferred), 0).otherwise(1) if preferred else F.lit(1)
    return x.groupBy("host").agg(F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos")).orderBy(rank, "pos")


def deduplicated_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two searches by an id, the first seen wins."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    from ..operators.relational import keep_first

    return keep_first(both, [key], [F.col("_o")]).drop("_o")


# --- the seven sources ---


def _obs(df: DataFrame, src, dst, rel: str, at="at", weight: float = 1.0, **more) -> DataFrame:
    cols = {"confidence": F.lit(0.95), "amount": F.lit(None).cast("double"), "duration": F.lit(None).cast("long"), "night": F.lit(None).cast("boolean"), "attr": F.lit(None).cast("string")} | more
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), F.lit(weight).alias("weight"), F.col(at).alias("at"), *(v.alias(k) for k, v in cols.items()), F.col("order")).where("src is not null and dst is not null")


def _id(kind: str, value):
    k = K.canonical_key(F.lit(kind), value)
    return F.when(F.coalesce(k, F.lit("")) != "", K.entity_id(F.lit(kind), k))


def cdr(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, events) of call records: CALLED, PINGED_AT (weight .2) and SHARED_HANDSET (5). Rows whose time cannot be read are left
    out of both; see quarantined()."""
    c = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns))
    r = rows.select(c("call_id").alias("order"), c("caller", "a_party").alias("a"), c("callee", "b_party").alias("b"), K.parsed_time(c("timestamp", "datetime", "call_time")).alias("at"), K.safe_number(c("duration_sec", "duration")).cast("long").alias("d"), c("tower_location", "cell_tower").alias("tower") if {"tower_location", "cell_tower"} & set(rows.columns) else F.lit(None).cast("string").alias("tower"), c("imei").alias("imei") if "imei" in rows.columns else F.lit(None).cast("string").alias("imei")).where("at is not null")
    a, b = _id("PHONE", F.col("a")), _id("PHONE", F.col("b"))
    calls = _obs(r, a, b, "CALLED", duration=F.col("d"), night=K.is_night(F.col("at")))
    pings = _obs(r.where("tower is not null"), a, _id("LOCATION", F.col("tower")), "PINGED_AT", weight=0.2)
    sets = r.where("imei is not null").select("imei", a.alias("p"), "at", "order").groupBy("imei", "p").agg(F.min("at").alias("at"), F.min("order").alias("order"))
    pairs = sets.join(sets.select("imei", F.col("p").alias("q")), "imei").where("p < q")
    shared = _obs(pairs, F.col("p"), F.col("q"), "SHARED_HANDSET", weight=5.0)
    events = r.select(F.lit("CALL").alias("kind"), F.col("at").alias("occurred_at"), F.array_compact(F.array(a, b)).alias("entity_ids"), F.create_map(F.lit("duration_sec"), F.col("d").cast("string"), F.lit("tower"), F.col("tower"), F.lit("night"), K.is_night(F.col("at")).cast("string"), F.lit("call_id"), F.col("order")).alias("details"))
    return calls.unionByName(pings).unionByName(shared), events


def transactions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = rows.select(F.col("txn_id").alias("order"), K.parsed_time(F.col("timestamp")).alias("at"), "from_account", "from_holder", "to_account", "to_holder", K.safe_number(F.col("amount_inr")).alias("amount"), "mode", "remarks").where("at is not null")
    a, b = _id("BANK_ACCOUNT", F.col("from_account")), _id("BANK_ACCOUNT", F.col("to_account"))
    holder = lambda name, account: _obs(r, F.coalesce(F.when(F.col(name).rlike(r"(?i)\b(ltd|limited|pvt|llp|traders|enterprises|exports|company)\b"), _id("ORGANIZATION", F.col(name))), _id("PERSON", F.col(name))), account, "OWNS_ACCOUNT")
    sent = _obs(r, a, b, "TRANSFERRED_TO", amount=F.col("amount"), attr=F.col("mode"))
    events = r.select(F.lit("TRANSFER").alias("kind"), F.col("at").alias("occurred_at"), F.array_compact(F.array(a, b)).alias("entity_ids"), F.create_map(F.lit("amount"), F.col("amount").cast("string"), F.lit("from_holder"), F.col("from_holder"), F.lit("to_holder"), F.col("to_holder"), F.lit("txn_id"), F.col("order"), F.lit("mode"), F.col("mode"), F.lit("remarks"), F.col("remarks")).alias("details"))
    return sent.unionByName(holder("from_holder", a)).unionByName(holder("to_holder", b)), events


def kyc(rows: DataFrame) -> DataFrame:
    r = rows.select("msisdn", "subscriber_name", "address", K.parsed_time(F.col("activation_date")).alias("at"), F.concat_ws("-", "msisdn", "subscriber_name").alias("order"))
    person = _id("PERSON", F.col("subscriber_name"))
    return _obs(r, person, _id("PHONE", F.col("msisdn")), "USES_PHONE").unionByName(_obs(r, person, _id("LOCATION", F.col("address")), "RESIDES_AT"))


def firs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, observations) of first information reports."""
    r = rows.select("fir_no", "police_station", K.parsed_time(F.col("date")).alias("at"), "complainant", "accused", F.col("text").alias("content"), F.col("fir_no").alias("order"))
    case = _id("CASE", F.col("fir_no"))
    each = r.select("*", F.posexplode("accused").alias("n", "name"))
    accused = _obs(each, _id("PERSON", F.col("name")), _id("CASE", F.col("fir_no")), "ACCUSED_IN")
    pairs = each.alias("x").join(each.select("fir_no", F.col("n").alias("m"), F.col("name").alias("other")), "fir_no").where("n < m")
    together = _obs(pairs, _id("PERSON", F.col("name")), _id("PERSON", F.col("other")), "CO_ACCUSED")
    complaint = _obs(r, _id("PERSON", F.col("complainant")), case, "COMPLAINANT_IN")
    place = _obs(r, case, _id("LOCATION", F.col("police_station")), "REGISTERED_AT")
    docs = r.select(F.sha2(F.concat_ws("|", F.lit("FIR"), "fir_no"), 256).alias("id"), F.lit("FIR").alias("source_type"), F.concat_ws(" ", F.lit("FIR"), "fir_no").alias("title"), "content", F.col("at").alias("occurred_at"))
    return docs, accused.unionByName(together).unionByName(complaint).unionByName(place)


def surveillance(rows: DataFrame) -> DataFrame:
    r = rows.select("report_id", K.parsed_time(F.col("timestamp")).alias("at"), "location", "subjects", "vehicles", F.col("report_id").alias("order"))
    s = r.select("*", F.posexplode_outer("subjects").alias("n", "name"))
    person = _id("PERSON", F.col("name"))
    out = _obs(s, person, _id("REPORT", F.col("report_id")), "SUBJECT_OF").unionByName(_obs(s, person, _id("LOCATION", F.col("location")), "SEEN_AT"))
    out = out.unionByName(_obs(s.select("*", F.explode("vehicles").alias("plate")), person, _id("VEHICLE", F.col("plate")), "ASSOCIATED_VEHICLE"))
    pairs = s.join(s.select("report_id", F.col("n").alias("m"), F.col("name").alias("other")), "report_id").where("n < m")
    return out.unionByName(_obs(pairs, person, _id("PERSON", F.col("other")), "MET"))


def social(rows: DataFrame) -> DataFrame:
    r = rows.select("post_id", "handle", "author_name", K.parsed_time(F.col("timestamp")).alias("at"), "location_tag", "mentions", F.col("post_id").alias("order"))
    handle = _id("SOCIAL_HANDLE", F.col("handle"))
    out = _obs(r, _id("PERSON", F.col("author_name")), handle, "OWNS_HANDLE").unionByName(_obs(r, handle, _id("LOCATION", F.col("location_tag")), "POSTED_FROM"))
    return out.unionByName(_obs(r.select("*", F.explode("mentions").alias("m")), handle, _id("SOCIAL_HANDLE", F.col("m")), "MENTIONED"))


def quarantined(rows: DataFrame, time_column: str) -> DataFrame:
    """Rows whose time cannot be read."""
    return rows.where(K.parsed_time(F.col(time_column)).isNull())


def court_parties(title):
    """(plaintiff, defendant) of "X v. Y"."""
    parts = F.split(title, r"(?i)\s+(?:vs?\.?|versus)\s+", 2)
    tidy = lambda c: F.trim(F.regexp_replace(c, r"(?i)\b(?:and (?:others|ors|another|anr)|& ors|through .*)\.?$", ""))
    return F.struct(tidy(F.get(parts, 0)).alias("plaintiff"), tidy(F.get(parts, 1)).alias("defendant"))


def leak_links(nodes: DataFrame, links: DataFrame, country: str, hops: int = 1, most_degree: int = 120) -> tuple[DataFrame, DataFrame]:
    """Nodes of a country with their neighbours, hubs pruned, and the links among them."""
    from ..operators.graph import pruned_neighbours

    start = nodes.where(F.col("countries").contains(country)).select(F.col("node_id").alias("id"))
    e = links.select(F.least("node_id_start", "node_id_end").alias("a"), F.greatest("node_id_start", "node_id_end").alias("b")).where("a <> b").distinct()
    near = pruned_neighbours(e, start, hops, most_degree)
    inside = links.join(near.select(F.col("id").alias("node_id_start")), "node_id_start", "left_semi").join(near.select(F.col("id").alias("node_id_end")), "node_id_end", "left_semi")
    return nodes.join(near.select(F.col("id").alias("node_id")), "node_id", "left_semi"), inside


def mapped_relation(verb, target_type):
    """Demo verbs to relation types: CONTROLS depends on what is controlled; RECRUITED turns round to REPORTS_TO. (rel_type, reversed)."""
    rel = F.when((verb == "CONTROLS") & (target_type == "BANK_ACCOUNT"), "OWNS_ACCOUNT").when((verb == "CONTROLS") & (target_type == "PHONE"), "USES_PHONE").when(verb == "RECRUITED", "REPORTS_TO").otherwise(verb)
    return F.struct(rel.alias("rel_type"), (verb == "RECRUITED").alias("reversed"))
