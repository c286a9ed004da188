"""Standing watches: one function matches a batch of documents, whether it comes from a stream or a backfill."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K

MOST_WATCHES = 20_000
AROUND = 90


# The least length of a selector by kind.
LEAST = {"PHONE": 10, "VEHICLE": 6, "TEXT": 4, "PERSON": 3, "ORGANIZATION": 3, "BANK_ACCOUNT": 3}
PAN, AADHAAR, GSTIN, PASSPORT = r"^[A-Z]{5}[0-9]{4}[A-Z]$", r"^[0-9]{12}$", r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]{3}$", r"^[A-Z][0-9]{7}$"


def normalised(watches: DataFrame, salt: str = "") -> DataFrame:
    """`watches` (kind, value, ...) with norm, display and error, by the rules of entity keys. norm is null where error says why the
    watch can't be stored: an unknown kind, an empty selector, one too short to tell records apart, or an identifier that does
    not validate. Aadhaar, PAN and passport numbers are kept as salted fingerprints and shown masked, never in clear."""
    kind, raw = F.upper(F.trim(F.coalesce("kind", F.lit("")))), F.trim(F.coalesce("value", F.lit("")))
    bare = F.upper(F.regexp_replace(raw, r"[\s-]", ""))
    of = F.when(bare.rlike(AADHAAR), "AADHAAR").when(bare.rlike(PAN), "PAN").when(bare.rlike(GSTIN), "GSTIN").when(bare.rlike(PASSPORT), "PASSPORT").when(K.valid_ifsc(bare), "IFSC").when(raw.contains("@"), "UPI")
    valid = K.validated(of, bare)["valid"]
    secret = of.isin("AADHAAR", "PAN", "PASSPORT")
    key = F.when(kind == "TEXT", F.lower(K.squashed(raw))).when(kind == "GOV_ID", F.when(secret, F.concat(F.lit("fp:"), K.identifier_print(salt, of, bare))).otherwise(bare)).otherwise(K.canonical_key(kind, raw))
    shown = F.when(kind.isin("PHONE", "VEHICLE", "TEXT"), key).when(kind == "GOV_ID", F.when(secret, K.masked(of, bare)).otherwise(bare)).otherwise(K.squashed(raw))
    least = F.create_map(*(F.lit(x) for kv in LEAST.items() for x in kv))[kind]
    error = (
        F.when(~kind.isin(*LEAST, "GOV_ID"), "unknown kind").when(raw == "", "empty").when((kind == "GOV_ID") & of.isNull(), "not a recognised identifier").when((kind == "GOV_ID") & of.isin("IFSC", "UPI"), "watch it as BANK_ACCOUNT")
        .when((kind == "GOV_ID") & ~valid, "the identifier did not validate").when(F.length(key) < least, F.concat(F.lit("needs "), least.cast("string"), F.lit(" characters or more")))
    )
    return watches.withColumns({"norm": F.when(error.isNull(), key), "display": F.when(error.isNull(), shown), "error": error})


def added(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table of watches (id, kind, norm, display, active) after `new` ones, as of normalised(): a selector that is watched already joins its
    watch and arms it again; of equal new ones the smallest id stays; what has an error is left out."""
    own = new.where("error is null").groupBy(F.upper(F.trim("kind")).alias("kind"), "norm").agg(F.min_by(F.struct("id", "display"), "id").alias("x"))
    old = stored.join(own.select("kind", "norm", F.lit(True).alias("again")), ["kind", "norm"], "left").select("id", "kind", "norm", "display", (F.col("active") | F.coalesce("again", F.lit(False))).alias("active"))
    fresh = own.join(stored.select("kind", "norm"), ["kind", "norm"], "left_anti").select("x.id", "kind", "norm", "x.display", F.lit(True).alias("active"))
    return old.unionByName(fresh)


def text_hits(docs: DataFrame, watches: DataFrame) -> DataFrame:
    """Case-folded substring hits of TEXT watches on title and content, with the first hit's surroundings. A document is read once by an
    automaton of all selectors. Watches are what analysts type: their count is checked, and beyond it they are taken in blocks."""
    w = watches.where("kind = 'TEXT' and active").select("id", "norm").where("norm is not null and norm <> ''")
    d = docs.select("id", F.concat_ws("\n", "title", "content").alias("hay"), "occurred_at")
    blocks = max(1, -(-w.count() // MOST_WATCHES))
    out = None
    for b in range(blocks):
        given = d.sparkSession.sparkContext.broadcast([(r["id"], r["norm"]) for r in w.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()])

        def run(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            automaton, by = ahocorasick.Automaton(), {}
            for watch, norm in given.value:
                by.setdefault(norm, []).append(watch)
            for norm in by:
                automaton.add_word(norm, norm)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for doc, hay, at in zip(batch["id"], batch["hay"], batch["occurred_at"]):
                    first: dict[str, int] = {}
                    if by and hay:
                        for end, norm in automaton.iter(hay.lower()):
                            first.setdefault(norm, end - len(norm) + 1)
                    for norm, begin in sorted(first.items()):
                        around = " ".join(hay[max(0, begin - AROUND) : begin + len(norm) + AROUND].split())
                        rows += [(watch, doc, "", "text", around, at) for watch in by[norm]]
                yield pd.DataFrame(rows, columns=["watch_id", "document_id", "entity_id", "matched_on", "snippet", "occurred_at"]).astype({"occurred_at": batch["occurred_at"].dtype})

        kind = docs.schema["id"].dataType.simpleString()
        hit = d.mapInPandas(run, f"watch_id string, document_id {kind}, entity_id string, matched_on string, snippet string, occurred_at timestamp_ntz")
        out = hit if out is None else out.unionAll(hit)
    return out


def key_hits(mentions: DataFrame, watches: DataFrame) -> DataFrame:
    """Hits of the other kinds by (type, key): mentions (document_id, entity_id, type, key, snippet, occurred_at, rank); the context of the lowest rank wins."""
    w = watches.where("kind <> 'TEXT' and active").select(F.col("id").alias("watch_id"), F.col("kind").alias("type"), F.col("norm").alias("key"))
    j = mentions.join(w, ["type", "key"])
    best = j.groupBy("watch_id", "document_id", "entity_id").agg(F.min_by(F.struct("snippet", "occurred_at"), F.struct("rank", "snippet")).alias("x"))
    return best.select("watch_id", "document_id", "entity_id", F.lit("key").alias("matched_on"), "x.snippet", "x.occurred_at")


def new_hits(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits not stored yet: one per (watch, document, entity), so a rescan adds none and statuses stay."""
    key = ["watch_id", "document_id", "entity_id"]
    return hits.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def tally(hits: DataFrame) -> DataFrame:
    return hits.groupBy("watch_id").agg(F.count("*").alias("hit_count"), F.max("occurred_at").alias("last_hit_at"))


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def scan(batch: DataFrame, watches: DataFrame, path: str) -> None:
    """Appends the batch's new text hits to the hits table at `path`: the body of the stream and of the backfill."""
    hits = text_hits(batch, watches)
    fresh = new_hits(hits, _stored(batch.sparkSession, path, hits.schema))
    fresh.write.mode("append").parquet(path)


def stream(docs: DataFrame, watches: DataFrame, path: str, checkpoint: str):
    """A query over a stream of documents; replayed batches add no hit twice."""
    return docs.writeStream.foreachBatch(lambda batch, _: scan(batch, watches, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entity_keys(entities: DataFrame) -> DataFrame:
    return entities.select("id", "type", K.canonical_key(F.col("type"), F.col("label")).alias("key"))
