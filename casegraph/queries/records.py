"""Resolution, watches, ledger, dossiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import numbered
from ..operators.store import shared_dir, written
from ..plans import dossier, ledger, mountains, resolve
from ..streaming import watches as W
from . import Tables, query


@query("""with m as (select 'LOCATION' as type, case when c_custkey % 2 = 0 then upper(c_mktsegment) else '  '||lower(c_mktsegment)||' ' end as text, c_custkey from customer) select 'LOCATION' as type, lower(trim(text)) as key, sha256('LOCATION|'||lower(trim(text))) id, arg_min(text, c_custkey) as label, count(*) mention_count from m group by 2""")
def exact_resolve(t: Tables) -> DataFrame:
    text = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")))
    m = t.customer.select(F.lit("LOCATION").alias("type"), text.alias("text"), F.col("c_custkey").alias("order"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return resolve.exact(m).select("type", "key", "id", "label", "mention_count")


@query("""with m as (select 'ravi kumar' as key, 'src'||(c_custkey % 4) source, min(c_custkey) f from customer group by all) select key || case when n > 1 then '#'||n else '' end as key, source from (select *, row_number() over (order by f, source) n from m)""")
def namesake_split(t: Tables) -> DataFrame:
    m = t.customer.select(F.lit("PERSON").alias("type"), F.lit("Ravi Kumar").alias("text"), F.concat(F.lit("src"), F.col("c_custkey") % 4).alias("source"), F.col("c_custkey").alias("order"))
    return resolve.namesakes(m).select("key", "source").distinct()


@query("with x as (select c_custkey, c_custkey // 3 g, c_custkey % 2 source from customer) select c_custkey id, min(c_custkey) over (partition by g, source) entity from x")
def fuzzy_resolve(t: Tables) -> DataFrame:
    """Three customers in a row have one name, with more or fewer words; those of one source are one."""
    last = F.translate(F.floor(F.col("c_custkey") / 3).cast("string"), "0123456789", "abcdefghij")
    middle = F.when(F.col("c_custkey") % 3 == 1, "kr ").when(F.col("c_custkey") % 3 == 2, "kumar ").otherwise("")
    e = t.customer.select(F.col("c_custkey").alias("id"), F.lit("PERSON").alias("type"), F.concat(F.lit("ravi "), middle, last, F.lit("sharma")).alias("key"), (F.col("c_custkey") % 2).cast("string").alias("source"))
    return resolve.fuzzy(e)


CODE = "translate(substr(md5(cast({0} as string)), 1, 14), '0123456789', 'ghijklmnop')"
FIRST, LAST = f"substr({CODE}, 1, 7)", f"substr({CODE}, 8, 7)"


@query("""select c_custkey id, s_suppkey list_id, case s_suppkey % 3 when 0 then 100.0::double when 1 then 95.0::double else 100 * 28 / 29::double end score, c_custkey % 2 = 0 and s_suppkey % 3 = 0 strong
 from customer join supplier on s_suppkey = c_custkey""")
def screening(t: Tables) -> DataFrame:
    """Suppliers are listed under a customer's name, as it is, with its words in the other order, or one letter short."""
    of = lambda x, k: F.expr(x.format(k))
    kind = F.when(F.col("c_custkey") % 2 == 0, "ORGANIZATION").otherwise("PERSON")
    a = t.customer.select(F.col("c_custkey").alias("id"), kind.alias("type"), F.concat_ws(" ", of(FIRST, "c_custkey"), of(LAST, "c_custkey")).alias("label"))
    first, last, by = of(FIRST, "s_suppkey"), of(LAST, "s_suppkey"), F.col("s_suppkey") % 3
    name = F.when(by == 0, F.concat_ws(" ", first, last)).when(by == 1, F.concat_ws(" ", last, first)).otherwise(F.concat_ws(" ", first, F.substring(last, 1, 6)))
    out = resolve.screened(a, t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("PERSON").alias("type"), name.alias("name")))
    return out.select("id", "list_id", "score", "strong")


@query("select distinct l_suppkey src, l_partkey % 500 dst, cast(count(*) as double) weight, count(*) count from lineitem where l_suppkey <> l_partkey % 500 group by 1, 2")
def entity_merge_redirect(t: Tables) -> DataFrame:
    from ..operators.edges import accumulate

    o = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("SUPPLIES").alias("rel_type"), F.lit(1.0).alias("weight"), F.col("l_shipdate").alias("at"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("long").alias("duration"), F.lit(None).cast("boolean").alias("night"), F.lit(None).cast("string").alias("attr"), F.col("l_orderkey").alias("order"))
    # a part and the part it is folded into are the same numbers, so suppliers keep theirs
    e = accumulate(o.withColumn("dst", F.col("dst") + 1000000).withColumn("rel_type", F.lit("SUPPLIES")))
    mapping = t.part.select((F.col("p_partkey") + 1000000).alias("id"), (F.col("p_partkey") % 500).alias("into"))
    return resolve.redirected(e, mapping).select("src", "dst", "weight", "count")


@query("select p_partkey id from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def orphan_entities(t: Tables) -> DataFrame:
    line = t.lineitem.where("l_returnflag = 'R'")
    return resolve.orphans(t.part.select(F.col("p_partkey").alias("id")), line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).where("dst is not null").select(F.col("dst").alias("src"), "dst"), t.spark.createDataFrame([], "entity_id long"))


WATCHES = [("w1", "TEXT", "license", True), ("w2", "TEXT", "idiot", True), ("w3", "TEXT", "zzzzqq", True), ("w4", "TEXT", "the", False)]


def _watches(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(WATCHES, "id string, kind string, norm string, active boolean")


def _docs(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit(None).cast("timestamp_ntz").alias("occurred_at"))


@query("select w watch_id, doc_id document_id, '' entity_id from documents, (values ('w1', 'license'), ('w2', 'idiot'), ('w3', 'zzzzqq')) x(w, norm) where contains(lower(source || chr(10) || text), norm)")
def watch_text_scan(t: Tables) -> DataFrame:
    return W.text_hits(_docs(t), _watches(t)).select("watch_id", "document_id", "entity_id")


@query("select 0::bigint again, count(*) n from documents, (values ('license'), ('idiot'), ('zzzzqq')) x(norm) where contains(lower(source || chr(10) || text), norm)")
def watch_rescan_idempotent(t: Tables) -> DataFrame:
    hits = written(W.text_hits(_docs(t), _watches(t)), "hits")
    again = W.new_hits(W.text_hits(_docs(t), _watches(t)), hits)
    return again.agg(F.count("*").alias("again")).crossJoin(hits.agg(F.count("*").alias("n")))


@query("select 'k'||(c_custkey % 3) watch_id, o_orderkey document_id, c_custkey entity_id from customer join orders on o_custkey = c_custkey where c_mktsegment = 'MACHINERY' and c_acctbal > 9000")
def watch_key_scan(t: Tables) -> DataFrame:
    w = t.customer.where("c_mktsegment = 'MACHINERY' and c_acctbal > 9000").select(F.concat(F.lit("k"), F.col("c_custkey") % 3).alias("id"), F.lit("PERSON").alias("kind"), F.lower("c_name").alias("norm"), F.lit(True).alias("active"))
    m = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("document_id"), F.col("c_custkey").alias("entity_id"), F.lit("PERSON").alias("type"), F.lower("c_name").alias("key"), F.lit("seen").alias("snippet"), F.col("o_orderdate").alias("occurred_at"), F.lit(1).alias("rank"))
    return W.key_hits(m, w).select("watch_id", "document_id", "entity_id")


@query("select doc_id, sha256(text) payload_hash from documents")
def payload_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("payload_hash"))


MERKLE = "with recursive l as (select row_number() over (order by doc_id) - 1 i, sha256(text) h from documents), r(lv, i, h) as (select 0, i, h from l union all select lv + 1, i // 2, case when count(*) = 2 then sha256(min(case when i % 2 = 0 then h end) || max(case when i % 2 = 1 then h end)) else sha256(max(h) || max(h)) end from r where lv < 14 group by lv, i // 2) select h root from r where lv = (select cast(ceil(log2(count(*))) as int) from documents) and i = 0"


@query(MERKLE)
def merkle_root(t: Tables) -> DataFrame:
    leaves = numbered(t.documents.select("doc_id", F.sha2("text", 256).alias("hash")), ["doc_id"]).select("i", "hash")
    return t.spark.createDataFrame([(ledger.merkle_root(written(leaves, "leaves")),)], "root string")


@query(MERKLE.replace("select h root", "select 0 + (select count(*) from documents) entries, h root"))
def append_only_log(t: Tables) -> DataFrame:
    """The same tree as an append-only log, in two appends: its length and its root from the peaks."""
    folder = f"{shared_dir(t.spark)}/casegraph/log-{uuid.uuid4().hex}"
    leaves = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    middle = leaves.agg(F.floor((F.min("doc_id") + F.max("doc_id")) / 2).alias("m"))
    both = leaves.crossJoin(F.broadcast(middle))  # one row
    mountains.append(both.where("doc_id <= m"), folder, ["doc_id"])
    n = mountains.append(both.where("doc_id > m"), folder, ["doc_id"])
    return t.spark.createDataFrame([(n, mountains.root(t.spark, folder))], "entries long, root string")


@query("select 7::bigint as index, 'content' why union all select 20, 'link'")
def chain_verify(t: Tables) -> DataFrame:
    """A ledger of the nations, two entries of which are changed. A chain is made entry by entry, so the table is a small one."""
    nations = t.nation.orderBy("n_nationkey").limit(25).collect()
    rows = ledger.append([{"timestamp": f"2024-01-01T00:00:{r['n_nationkey']:02d}", "actor": "a", "action": "ADD", "subject_type": "nation", "subject_id": str(r["n_nationkey"]), "payload": {"name": r["n_name"]}} for r in nations], None)
    rows[7]["detail"] = "changed"
    rows[20]["previous_hash"] = "0" * 64
    for i in range(20, len(rows)):
        rows[i]["previous_hash"] = rows[i]["previous_hash"] if i == 20 else rows[i - 1]["entry_hash"]
        rows[i]["entry_hash"] = ledger.entry_hash(rows[i])
    return ledger.broken(t.spark.createDataFrame(rows))


def _case(t: Tables) -> dossier.Case:
    ents = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit("PERSON").alias("type"), F.col("c_name").alias("label"), F.lower("c_name").alias("canonical_key"), F.lit(1).alias("mention_count"))
    e = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst")).agg(F.lit("TRANSFERRED_TO").alias("rel_type"), F.count("*").cast("double").alias("weight"), F.sum(F.col("l_extendedprice").cast("decimal(38,4)")).cast("double").alias("total_amount"))
    ev = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("TRANSFER").alias("kind"), F.col("o_orderdate").alias("occurred_at"), F.array(F.concat(F.lit("C"), "o_custkey")).alias("entity_ids"))
    al = t.spark.createDataFrame([("a", 0.9, ["C3"])], "title string, score double, entity_ids array<string>")
    evid = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"), F.concat(F.lit("C"), "o_custkey").alias("entity_id"), F.lit(0.9).alias("confidence"))
    docs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("content"))
    return dossier.Case(ents, e, ev, al, evid, docs)


@query("select 'S'||l_suppkey other, cast(count(*) as double) weight from orders join lineitem on o_orderkey = l_orderkey where o_custkey = 3 group by 1 order by weight desc, other limit 40")
def dossier_associates(t: Tables) -> DataFrame:
    return dossier.dossier(_case(t), "C3")["associates"]


@query("select strftime(o_orderdate, '%G-W%V') grp, cast(count(*) as double) as value from orders where o_custkey = 3 group by 1")
def dossier_weekly(t: Tables) -> DataFrame:
    return dossier.dossier(_case(t), "C3")["weekly"]


@query("select o_orderkey id, o_orderdate occurred_at from orders where o_custkey = 3 order by o_orderdate desc, o_orderkey limit 120")
def entity_timeline(t: Tables) -> DataFrame:
    return dossier.timeline(_case(t), "C3").select("id", "occurred_at")


@query("select strftime(o_orderdate, '%Y-%m-%d') bucket, 'TRANSFER' kind, count(*) n from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1996-12-31' group by 1")
def timeline_histogram(t: Tables) -> DataFrame:
    return dossier.timeline_view(_case(t), ["TRANSFER"], "1996-01-01", "1996-12-31")[1]


@query()
def routed_question(t: Tables) -> DataFrame:
    return dossier.answer(_case(t), "show the money transfers")[1]
