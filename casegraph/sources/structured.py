"""A structured case of nine CSV files, and a small seeded corpus for tests and demonstrations."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from .readers import csv, mapped_relation

FILES = {"entities": "01_entities_nodes.csv", "relationships": "02_relationships_edges.csv", "transactions": "03_financial_transactions.csv", "complaints": "04_ncrp_complaints.csv", "documents": "05_case_documents.csv", "aliases": "06_aliases_unresolved.csv", "timeline": "07_timeline_events.csv", "places": "08_geo_locations.csv", "calls": "09_cdr.csv"}


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """entities, relationships, events, documents and aliases of a case, with ids that are hashes of (type, record id), so a reload gives
    the same rows. Missing files are left out."""
    raw = {}
    for name, file in FILES.items():
        try:
            raw[name] = csv(spark, f"{folder}/{file}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    out: dict[str, DataFrame] = {}
    if "entities" in raw:
        kind = F.upper("entity_type")
        label = F.substring(F.trim("name"), 1, 300)
        out["entities"] = raw["entities"].select(K.entity_id(kind, F.col("entity_id")).alias("id"), kind.alias("type"), label.alias("label"), K.canonical_key(kind, label).alias("canonical_key"), F.array_compact(F.array(F.nullif(F.trim("alias"), F.lit("")))).alias("aliases"), F.map_filter(F.create_map(*(x for c in ("age", "role_in_network", "sub_network", "location_city", "location_state", "status", "risk_flag", "notes") for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull() & (v != "")).alias("attributes"), F.col("entity_id").alias("record_id"))
    if "relationships" in raw and "entities" in out:
        ends = out["entities"].select("record_id", "id", "type")
        s, d = ends.select(F.col("record_id").alias("source_id"), F.col("id").alias("src")), ends.select(F.col("record_id").alias("target_id"), F.col("id").alias("dst"), F.col("type").alias("to"))
        r = raw["relationships"].join(s, "source_id").join(d, "target_id").withColumn("m", mapped_relation(F.upper("relationship_type"), F.col("to")))
        out["relationships"] = r.select(F.when(F.col("m.reversed"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("m.reversed"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "m.rel_type", F.coalesce(K.safe_number(F.col("weight")), F.lit(1.0)).alias("weight"), K.parsed_time(F.col("detected_date")).alias("at")).where("src <> dst")
    events = []
    if "transactions" in raw:
        events.append(raw["transactions"].select(F.lit("TRANSFER").alias("kind"), K.parsed_time(F.concat_ws(" ", "txn_date", "txn_time")).alias("occurred_at"), F.array_compact(F.array("from_account", "to_account")).alias("records"), F.create_map(F.lit("amount"), F.col("amount_inr"), F.lit("txn_id"), F.col("txn_id")).alias("details")))
    if "complaints" in raw:
        events.append(raw["complaints"].select(F.lit("COMPLAINT").alias("kind"), K.parsed_time(F.col("filing_date")).alias("occurred_at"), F.array_compact(F.array("linked_account")).alias("records"), F.create_map(F.lit("complaint_id"), F.col("complaint_id"), F.lit("amount"), F.col("amount_defrauded_inr"), F.lit("modus_operandi"), F.col("modus_operandi"), F.lit("city"), F.col("complainant_city")).alias("details")))
    if "timeline" in raw:
        events.append(raw["timeline"].select(F.upper("event_type").alias("kind"), K.parsed_time(F.concat_ws(" ", "event_date", "event_time")).alias("occurred_at"), F.split("linked_entity_ids", r"\s*;\s*").alias("records"), F.create_map(F.lit("severity"), F.col("severity")).alias("details")))
    if "calls" in raw:
        events.append(raw["calls"].select(F.lit("CALL").alias("kind"), K.parsed_time(F.col("call_time")).alias("occurred_at"), F.array("caller_phone", "callee_phone").alias("records"), F.create_map(F.lit("duration_sec"), F.col("duration_sec"), F.lit("call_id"), F.col("call_id")).alias("details")))
    for e in events:
        out["events"] = out["events"].unionByName(e) if "events" in out else e
    if "documents" in raw:
        out["documents"] = raw["documents"].select(F.col("doc_id").alias("id"), F.upper("doc_type").alias("source_type"), F.substring("title", 1, 300).alias("title"), F.col("brief_description").alias("content"), K.parsed_time(F.col("date_created")).alias("occurred_at"))
    if "aliases" in raw:
        out["aliases"] = raw["aliases"].select(F.col("name_variant_1").alias("a"), F.col("name_variant_2").alias("b"), "entity_id", K.safe_number(F.col("confidence_score")).alias("confidence"))
    return out


def synthetic(spark: SparkSession, people: int = 40, calls: int = 400, seed: int = 7) -> dict[str, DataFrame]:
    """Invented call records, transfers and subscriber records with planted patterns, and the truth: a short-lived phone that shares a
    handset with its user, and near-threshold credits that are passed on."""
    r, start = random.Random(seed), datetime(2024, 1, 1)
    phone = lambda i: f"9{800000000 + i * 7919}"
    when = lambda d, h=None: (start + timedelta(days=d, hours=r.randrange(24) if h is None else h, minutes=r.randrange(60))).strftime("%Y-%m-%d %H:%M:%S")
    cdr = [(f"c{i}", phone(r.randrange(people)), phone(r.randrange(people)), when(r.randrange(30)), str(r.randrange(5, 900)), f"Tower {r.randrange(8)}", f"IMEI{i % people}") for i in range(calls)]
    cdr += [(f"b{i}", phone(people), phone(r.randrange(1, people)), when(3 + i % 5, 23), "40", "Tower 1", "IMEI0") for i in range(12)]
    txn = [(f"t{i}", when(r.randrange(30)), f"{1000000000 + r.randrange(20)}", f"{1000000000 + r.randrange(20)}", str(round(r.uniform(500, 30_000), 2))) for i in range(200)]
    txn += [(f"s{i}", when(10 + i % 3), f"{1000000000 + i}", "1000000099", str(45_000 + 900 * i)) for i in range(5)] + [("s9", when(14), "1000000099", "1000000050", "220000")]
    kyc = [(phone(i), f"Person {chr(65 + i % 26)} Surname{i}", f"Street {i}", "2023-01-01") for i in range(people)]
    return {
        "cdr": spark.createDataFrame(cdr, "call_id string, caller string, callee string, timestamp string, duration_sec string, tower_location string, imei string"), "transactions": spark.createDataFrame([(a, t, f, "", d, "", m, "NEFT", "") for a, t, f, d, m in txn], "txn_id string, timestamp string, from_account string, from_holder string, to_account string, to_holder string, amount_inr string, mode string, remarks string"),
        "kyc": spark.createDataFrame(kyc, "msisdn string, subscriber_name string, address string, activation_date string"), "truth": spark.createDataFrame([("burner_phone", phone(people), phone(0)), ("structuring", "1000000099", "1000000050")], "pattern string, subject string, user string"),
    }
