"""Predicates, semi and anti joins, set operations, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import places
from ..operators import edges
from ..operators import relational as R
from . import Tables, query


@query("select event_id, event_type, ts from events where event_type in ('purchase', 'error') and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20 12:00:00'")
def filter_kind_range(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("purchase", "error") & F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))).select("event_id", "event_type", "ts")


@query("select 'part' kind, p_partkey id, p_name label from part where p_name ilike '%1%2%' or p_brand ilike '%#34%' union all select 'customer', c_custkey, c_name from customer where c_name ilike '%0012%'")
def ilike_search(t: Tables) -> DataFrame:
    p = t.part.where(F.col("p_name").ilike("%1%2%") | F.col("p_brand").ilike("%#34%")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return p.unionAll(t.customer.where(F.col("c_name").ilike("%0012%")).select(F.lit("customer"), "c_custkey", "c_name"))


@query("select c_custkey from customer where contains(regexp_replace(c_name, '[^0-9]', '', 'g'), '0077')")
def digits_search(t: Tables) -> DataFrame:
    return t.customer.where(K.digits(F.col("c_name")).contains("0077")).select("c_custkey")


@query("""with a as (select 'entity' kind, c_custkey id, c_name label from customer where c_name ilike '%11%' order by c_custkey limit 10), b as (select 'part' kind, p_partkey id, p_name label from part where p_name ilike '%11%' order by p_partkey limit 10),
 d as (select 'document' kind, doc_id id, source label from documents where text ilike '%license%' order by doc_id limit 10) select * from a union all select * from b union all select * from d""")
def global_search(t: Tables) -> DataFrame:
    """Up to ten of each kind."""
    top = lambda df, kind, id_, label, where: df.where(where).orderBy(id_).limit(10).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(label).alias("label"))
    return top(t.customer, "entity", "c_custkey", "c_name", F.col("c_name").ilike("%11%")).unionAll(top(t.part, "part", "p_partkey", "p_name", F.col("p_name").ilike("%11%"))).unionAll(top(t.documents, "document", "doc_id", "source", F.col("text").ilike("%license%")))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events where cast(json_extract_string(props, '$.k') as bigint) in (5, 7, 11)")
def json_path_filter(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where(k.isin(5, 7, 11)).select("event_id", k.alias("k"))


@query("select o_orderkey, o_orderpriority from orders left join customer on c_custkey = o_custkey and c_mktsegment <> 'MACHINERY' where (c_mktsegment is null or c_mktsegment not in ('BUILDING', 'FURNITURE')) and o_orderstatus = 'P'")
def null_safe_role_filter(t: Tables) -> DataFrame:
    j = t.orders.where("o_orderstatus = 'P'").join(t.customer.where("c_mktsegment <> 'MACHINERY'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.where(F.col("c_mktsegment").isNull() | ~F.col("c_mktsegment").isin("BUILDING", "FURNITURE")).select("o_orderkey", "o_orderpriority")


@query("""with e as (select user_id, list_sort(list_distinct(list(event_type))) kinds from events group by user_id) select user_id from e where list_contains(kinds, 'signup') and list_contains(kinds, 'purchase')""")
def array_membership(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return e.where(F.array_contains("kinds", "signup") & F.array_contains("kinds", "purchase")).select("user_id")


NAMED = "concat(case p_partkey % 6 when 0 then 'State of ' when 1 then 'High Court of ' when 2 then 'Customs House ' else '' end, p_name, case p_partkey % 9 when 0 then ', Sub-Inspector' when 1 then ' (Witness 3)' when 2 then ' Complainant' else '' end)"
OF_KIND, IN_COURT = "case p_partkey % 4 when 0 then 'PERSON' else 'ORGANIZATION' end", "case p_partkey % 13 when 0 then 'Judge' when 1 then 'Police witness' when 2 then 'accused' end"


@query(rf"""with x as (select p_partkey, {NAMED} label, {OF_KIND} kind, {IN_COURT} role from part)
 select p_partkey, regexp_matches(lower(label), 'victim|complainant|witness|police officer|inspector|constable|investigating officer') or coalesce(regexp_matches(lower(role), 'victim|complainant|witness|police'), false) protected,
 coalesce(lower(role) = 'judge', false) or kind = 'ORGANIZATION' and (starts_with(label, 'State of ') or regexp_matches(label, '(?i)\b(high court|customs)\b')) non_subject from x""")
def protected_party_filter(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.expr(NAMED).alias("label"), F.expr(OF_KIND).alias("kind"), F.expr(IN_COURT).alias("record_role"))
    protected = K.protected_party({"record_role": F.col("record_role")}, F.col("label"))
    return x.select("p_partkey", protected.alias("protected"), K.non_subject({"court_role": F.col("record_role")}, F.col("label"), F.col("kind")).alias("non_subject"))


JUNK = (("PERSON", "''", "'empty'"), ("PERSON", "'unknown'", "'stopword'"), ("PERSON", "'---'", "'punctuation'"), ("LOCATION", "cast(p_size as string)", "'bare number'"), ("LOCATION", "substr(upper(p_name), 1, 2)", "'country code'"), ("ORGANIZATION", "substr(p_name, 1, 2)", "'too short'"), ("PERSON", "concat('two ', p_name)", "'descriptor'"), ("PERSON", "p_name", "null"))
_JUNK = lambda i: f"case p_partkey % {len(JUNK)} " + " ".join(f"when {k} then {x[i]}" for k, x in enumerate(JUNK)) + " end"


@query(f"select p_partkey, {_JUNK(2)} is not null junk, {_JUNK(2)} reason from part")
def junk_mentions(t: Tables) -> DataFrame:
    kind = F.expr("case p_partkey % 8 " + " ".join(f"when {k} then '{x[0]}'" for k, x in enumerate(JUNK)) + " end")
    j = K.junk_mention(kind, F.expr(_JUNK(1)))
    return t.part.select("p_partkey", j["junk"].alias("junk"), j["reason"].alias("reason"))


@query("select distinct c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def semi_poi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey) and not exists (select 1 from supplier where s_suppkey = c_custkey)")
def anti_orphans(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left_anti").select("c_custkey")


@query("with c as (select distinct l_partkey, o_orderpriority from lineitem join orders on o_orderkey = l_orderkey) select l_partkey from c group by 1 having count(*) = 1 and min(o_orderpriority) = '1-URGENT'")
def cited_only_here(t: Tables) -> DataFrame:
    c = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    here, other = c.where("o_orderpriority = '1-URGENT'").select("l_partkey").distinct(), c.where("o_orderpriority <> '1-URGENT'").select("l_partkey")
    return here.join(other, "l_partkey", "left_anti")


@query("""with p as (select l_suppkey a, l_partkey b, cast(count(*) as bigint) w from lineitem group by all), n as (select s_suppkey id from supplier where s_nationkey < 5), m as (select p_partkey id from part where p_size <= 5)
 select a, b, w from p where a in (select id from n) and b in (select id from m)""")
def subgraph_induction(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.count("*").alias("w"))
    return p.join(t.supplier.where("s_nationkey < 5"), F.col("a") == F.col("s_suppkey"), "left_semi").join(t.part.where("p_size <= 5"), F.col("b") == F.col("p_partkey"), "left_semi")


@query("select p_partkey, 'P'||p_partkey as label, 'size='||p_size||',type='||p_type kept from part")
def property_allow_list(t: Tables) -> DataFrame:
    """Only registered properties stay."""
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("secret"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    kept = F.map_filter(m, lambda k, v: k.isin("size", "type"))
    return t.part.select("p_partkey", F.concat(F.lit("P"), "p_partkey").alias("label"), F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("kept"))


@query("""select c_custkey, case when c_mktsegment = 'HOUSEHOLD' then regexp_replace('Statement of '||c_name||' on record', '\\b'||c_name||'\\b', '[VICTIM]') else 'Statement of '||c_name||' on record' end as text_masked from customer""")
def masking_projection(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Statement of "), "c_name", F.lit(" on record"))
    return t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.regexp_replace(text, F.concat(F.lit(r"\b"), "c_name", F.lit(r"\b")), F.lit("[VICTIM]"))).otherwise(text).alias("text_masked"))


@query("select o_orderkey, case when o_orderstatus = 'P' and o_totalprice >= 200000 then 'Pending analyst review' else o_orderpriority end label from orders")
def governance_redaction(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") >= 200000), "Pending analyst review").otherwise(F.col("o_orderpriority")).alias("label"))


@query("select c_custkey id from customer where c_mktsegment = 'MACHINERY' union select s_suppkey from supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id")).union(t.supplier.select("s_suppkey")).distinct()


@query("select c_custkey id, c_name as name, c_mktsegment segment, null::double balance from customer union all select s_suppkey, s_name, null, s_acctbal from supplier")
def diagonal_concat(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("select distinct o_custkey id from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def intersect_sources(t: Tables) -> DataFrame:
    s = lambda x: t.orders.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("id"))
    return s("F").intersect(s("O"))


@query("select o_custkey id from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O'")
def except_all(t: Tables) -> DataFrame:
    s = lambda x: t.orders.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("id"))
    return s("F").exceptAll(s("O"))


@query("select c_custkey, c_acctbal, (select count(*) from customer) total, false complete from customer order by c_acctbal desc nulls last, c_custkey limit 25 offset 50")
def page_with_total(t: Tables) -> DataFrame:
    return R.page(t.customer.select("c_custkey", "c_acctbal"), [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], 50, 25)


@query("select user_id, event_id, ts, rank from (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id) rank from events) where rank <= 5")
def top_n_per_group(t: Tables) -> DataFrame:
    return R.top_per_group(t.events, ["user_id"], [F.desc("ts"), F.col("event_id")], 5).select("user_id", "event_id", "ts", F.col("rank").cast("long").alias("rank"))


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts, event_id) n from events where event_type = 'error') where n = 3")
def nth_event(t: Tables) -> DataFrame:
    return R.top_per_group(t.events.where("event_type = 'error'"), ["user_id"], [F.col("ts"), F.col("event_id")], 3).where("rank = 3").select("user_id", "event_id", "ts")


@query("select text, min(doc_id) doc_id from documents group by text")
def dedupe_keep_first(t: Tables) -> DataFrame:
    """Groups by the SHA-256 of the text (null: its own group), so that no text is compared; a task ships one row of each group."""
    docs = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    return R.keep_first(docs, ["digest"], [F.col("doc_id")]).drop("digest")


@query("select source, lang, cast(count(*) as bigint) n from documents group by all having count(*) > 5")
def duplicate_titles(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")).where("n > 5")


@query("""with d as (select l_suppkey s, cast(count(*) as bigint) degree from lineitem group by 1), x as (select s, degree, s_acctbal / 100 + 0.02 * degree score from d join supplier on s = s_suppkey) select s, degree, cast(round(cast(score as decimal(18,6)), 4) as double) score from x order by score desc, s limit 20""")
def relevance_topk(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("s")).agg(F.count("*").alias("degree"))
    x = d.join(t.supplier, F.col("s") == F.col("s_suppkey")).select("s", "degree", (F.col("s_acctbal") / 100 + 0.02 * F.col("degree")).alias("score"))
    return x.withColumn("score", F.round(F.col("score").cast("decimal(18,6)"), 4).cast("double")).orderBy(F.desc("score"), "s").limit(20)


@query("select n_name, r_name from nation join region on contains(r_name, substr(n_name, 1, 1)) or contains(n_name, r_name) where r_regionkey = (select min(r2.r_regionkey) from region r2 where contains(r2.r_name, substr(n_name, 1, 1)) or contains(n_name, r2.r_name))")
def region_match(t: Tables) -> DataFrame:
    """First match of a small closed table (five regions), broadcast."""
    j = t.nation.join(F.broadcast(t.region), F.col("r_name").contains(F.substring("n_name", 1, 1)) | F.col("n_name").contains(F.col("r_name")))
    return j.groupBy("n_name").agg(F.min_by("r_name", "r_regionkey").alias("r_name"))


def _places_sql() -> str:
    points = lambda rows: ", ".join(f"('{k}', {a}::double, {b}::double)" for k, (a, b) in rows.items())
    nations = ", ".join(f"('{k}', '{n}', {a}::double, {b}::double)" for k, (n, a, b) in places.COUNTRIES.items())
    return f"city(k, lat, lon) as (values {points(places.CITIES)}), state(k, lat, lon) as (values {points(places.states())}), court(k, lat, lon) as (values {points(places.courts())}), country(k, name, lat, lon) as (values {nations})"


def _choice(names, by: str) -> str:
    """The name of number `by`, as an expression that both engines read."""
    return f"case {by} % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


CODE = f"case c_custkey % 4 when 0 then {_choice(list(places.COUNTRIES), 'c_nationkey')} when 1 then 'xx' end"
NOTE = f"""case c_custkey % 3 when 0 then concat('Seen near ', upper({_choice(list(places.CITIES), "c_custkey")}), ', ', {_choice(list(places.states()), "c_nationkey")}) when 1 then concat('From ', {_choice(list(places.states()), "c_custkey")}, ' yesterday')
 else concat('Heard at the ', {_choice(list(places.courts()), "c_custkey")}, ' court') end"""


@query(rf"""with {_places_sql()}, x as (select c_custkey, {CODE} code, {NOTE} note from customer), y as (select *, lower(regexp_extract(note, '{places.pattern(places.CITIES)}', 1)) c, lower(regexp_extract(note, '{places.pattern(places.states())}', 1)) s from x),
 seat as (select c_custkey, arg_max(court.lat, length(court.k)) lat, arg_max(court.lon, length(court.k)) lon from y join court on contains(lower(note), court.k) group by 1)
 select y.c_custkey, case when country.k is not null then 'country' when c <> '' then 'city' when s <> '' then 'state' when seat.lat is not null then 'court' end as precision, coalesce(country.lat, city.lat, state.lat, seat.lat) lat, coalesce(country.lon, city.lon, state.lon, seat.lon) lon
 from y left join country on country.k = y.code left join city on city.k = y.c left join state on state.k = y.s left join seat on seat.c_custkey = y.c_custkey""")
def located_texts(t: Tables) -> DataFrame:
    x = t.customer.select("c_custkey", F.expr(CODE).alias("code"), F.expr(NOTE).alias("note")).withColumn("at", places.locate(F.col("code"), F.col("note")))
    return x.select("c_custkey", "at.precision", "at.lat", "at.lon")


@query("""with calls as (select l_suppkey % 300 a, l_partkey % 300 b, count(*) n from lineitem group by 1, 2), arcs as (select a phone, b other, n from calls union all select b, a, n from calls), hit as (select phone, sum(n) n from arcs where other % 7 = 0 group by 1),
 uses as (select distinct o_custkey person, o_orderkey % 300 phone from orders) select person, cast(sum(n) as bigint) contacts from uses join hit using (phone) group by 1""")
def foreign_contacts(t: Tables) -> DataFrame:
    calls = t.lineitem.select((F.col("l_suppkey") % 300).alias("a"), (F.col("l_partkey") % 300).alias("b"), F.lit(1).alias("n"))
    uses = t.orders.select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 300).alias("phone"))
    return edges.foreign_contacts(uses, calls, t.spark.range(0, 300, 7).withColumnRenamed("id", "phone"))
