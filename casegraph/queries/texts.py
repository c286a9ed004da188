"""Text, identifiers, similarity and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import similarity as S
from ..functions import statutes
from ..functions import text as T
from ..operators.store import written
from ..plans import linkage, search
from . import Tables, query


@query("""select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z.]+')) as int) emails, cast(len(regexp_extract_all(text, '\\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\\b')) as int) ips, cast(len(regexp_extract_all(text, '[0-9]{9,}')) as int) numbers from documents""")
def regex_identifiers(t: Tables) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0))
    return t.documents.select("doc_id", n(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z.]+").alias("emails"), n(r"\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b").alias("ips"), n(r"[0-9]{9,}").alias("numbers"))


@query()
def identifier_extraction(t: Tables) -> DataFrame:
    return T.identifiers(t.documents)


@query()
def identifier_summary(t: Tables) -> DataFrame:
    x = T.identifiers(t.documents)
    ok = K.validated(F.col("kind"), F.col("value"))["valid"]
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


NINE = "lpad(cast((o_orderkey * 7919 + o_custkey) % 1000000000 as string), 9, '0')"
PHONE_RAW = f"case o_orderkey % 5 when 0 then concat('9', {NINE}) when 1 then concat('09', {NINE}) when 2 then concat('+91 9', substr({NINE}, 1, 4), '-', substr({NINE}, 5, 5)) when 3 then concat('+44 20 ', substr({NINE}, 1, 8)) else substr({NINE}, 1, 4) end"


@query(f"select o_orderkey, {PHONE_RAW} raw, case o_orderkey % 5 when 3 then concat('4420', substr({NINE}, 1, 8)) when 4 then substr({NINE}, 1, 4) else concat('9', {NINE}) end norm, o_orderkey % 5 = 3 foreign_ from orders")
def phone_keys(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", F.expr(PHONE_RAW).alias("raw"))
    return df.select("o_orderkey", "raw", K.norm_phone(F.col("raw")).alias("norm"), K.is_international(F.col("raw")).alias("foreign_"))


PERSON_RAW = "concat(case p_partkey % 6 when 0 then 'Shri. Md. ' when 1 then concat('D', chr(39)) when 2 then 'Smt ' when 3 then 'Abdul-' when 4 then '  Mohammed ' else '' end, p_name)"
ORG_RAW = "concat(p_name, case p_partkey % 5 when 0 then ' & Sons Pvt. Ltd.' when 1 then ' Company' when 2 then ' (India) Private  Limited' when 3 then ', Co' else '' end)"


@query(rf"""with x as (select p_partkey, 'PERSON' kind, {PERSON_RAW} raw from part union all select p_partkey, 'ORGANIZATION', {ORG_RAW} from part)
 select p_partkey, kind, raw, case kind when 'PERSON' then regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^(?:shri|smt|sri|mr|mrs|ms|miss|dr|adv|kum)\.?\s+', '', 'i'), '[.''-]', '', 'g'), '\s+', ' ', 'g'))), '^(?:mohd|md|mohammad|mohammed)\b', 'mohd')
 else lower(trim(regexp_replace(regexp_replace(regexp_replace(raw, '\b(?:pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|llp|co\.?|company)\b\.?', '', 'gi'), '[^\w& ]', '', 'g'), '\s+', ' ', 'g'))) end canonical from x""")
def canonical_keys(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.lit("PERSON").alias("kind"), F.expr(PERSON_RAW).alias("raw")).union(t.part.select("p_partkey", F.lit("ORGANIZATION"), F.expr(ORG_RAW)))
    return x.select("p_partkey", "kind", "raw", K.canonical_key(F.col("kind"), F.col("raw")).alias("canonical"))


def _verhoeff_sql(x: str) -> str:
    """The checksum in the dihedral group, over the tables as lists."""
    each = f"list_transform(range(0, length({x})), lambda i: {K.VERHOEFF_P}[i % 8 + 1][cast(substr({x}, length({x}) - i, 1) as int) + 1])"
    return f"list_reduce(list_prepend(0, {each}), lambda a, b: {K.VERHOEFF_D}[a + 1][b + 1])"


@query(f"with x as (select p_partkey, cast(p_partkey * 7919 as varchar) digits from part) select p_partkey, digits, {K.VERHOEFF_INVERSE}[{_verhoeff_sql("(digits || '0')")} + 1] check_digit from x")
def verhoeff(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_partkey") * 7919).cast("string").alias("digits")).select("p_partkey", "digits", K.verhoeff_digit(F.col("digits")).alias("check_digit"))


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOUR = "lpad(cast(c_custkey * 31 % 10000 as string), 4, '0')"
ID_KIND = "case c_custkey % 4 when 0 then 'PAN' when 1 then 'IFSC' when 2 then 'GSTIN' else 'AADHAAR' end"
ID_RAW = f"""case c_custkey % 4 when 0 then concat('ABC', case when c_custkey % 8 = 0 then 'P' else 'D' end, 'E', {FOUR}, 'F') when 1 then concat('SBIN', case when c_custkey % 8 = 1 then '0' else '1' end, '00', {FOUR})
 when 2 then concat('27AAPFU', {FOUR}, 'F1Z', substr('{ALPHABET}', c_custkey % 36 + 1, 1)) else concat(cast(c_custkey % 10 as string), '2341', lpad(cast(c_custkey * 7919 % 10000000 as string), 7, '0')) end"""


@query(f"""with x as (select c_custkey, {ID_KIND} kind, {ID_RAW} raw from customer), y as (select *, list_sum(list_transform(range(0, 14), lambda i: ((strpos('{ALPHABET}', substr(raw, i + 1, 1)) - 1) * (1 + i % 2)) // 36 + ((strpos('{ALPHABET}', substr(raw, i + 1, 1)) - 1) * (1 + i % 2)) % 36)) total from x),
 z as (select *, case kind when 'PAN' then substr(raw, 4, 1) = 'P' when 'IFSC' then substr(raw, 5, 1) = '0' when 'GSTIN' then substr('{ALPHABET}', cast((36 - total % 36) % 36 + 1 as int), 1) = substr(raw, 15, 1) else substr(raw, 1, 1) >= '2' and {_verhoeff_sql("regexp_replace(raw, '[^0-9]', '', 'g')")} = 0 end valid from y)
 select c_custkey, kind, raw, valid, case when valid then 'ok' when kind in ('AADHAAR', 'GSTIN') then 'checksum or format' else 'format' end reason from z""")
def identifier_validation(t: Tables) -> DataFrame:
    v = K.validated(F.col("kind"), F.col("raw"))
    return t.customer.select("c_custkey", F.expr(ID_KIND).alias("kind"), F.expr(ID_RAW).alias("raw")).select("c_custkey", "kind", "raw", v["valid"].alias("valid"), v["reason"].alias("reason"))


MASK_RAW = f"case c_custkey % 3 when 0 then concat('23412341', {FOUR}) when 1 then concat('ABCPE', {FOUR}, 'F') else concat('K123', {FOUR}) end"
MASK_KIND = "case c_custkey % 3 when 0 then 'AADHAAR' when 1 then 'PAN' else 'PASSPORT' end"


@query(f"select c_custkey, {MASK_KIND} kind, case c_custkey % 3 when 0 then concat('XXXX XXXX ', {FOUR}) when 1 then concat('ABCXX', {FOUR}, 'X') else concat('XXXX', {FOUR}) end masked from customer")
def identifier_masks(t: Tables) -> DataFrame:
    x = t.customer.select("c_custkey", F.expr(MASK_KIND).alias("kind"), F.expr(MASK_RAW).alias("raw"))
    return x.select("c_custkey", "kind", K.masked(F.col("kind"), F.col("raw")).alias("masked"))


@query("select c_custkey, substr(sha256('pepper|NAME|'||upper(regexp_replace(c_name, '[ -]', '', 'g'))), 1, 32) print from customer")
def identifier_prints(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", K.identifier_print("pepper", F.lit("NAME"), F.regexp_replace("c_name", "[ -]", "")).alias("print"))


@query("""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, cast(len(regexp_extract_all(html, 'href="[^"]*"')) as int) links from pages""")
def html_title_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.html_title(F.col("html")).alias("title"), F.size(T.html_links(F.col("html"))).alias("links"))


@query()
def html_readable(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.html_text(F.col("html")).alias("text"), T.readable(F.col("html")).alias("article"))


@query("""with n as (select doc_id, text, unnest(range(greatest(1, cast(ceil(length(text) / 1200.0) as int)))) n from documents), p as (select doc_id, cast(n as int) n, trim(substr(text, n * 1200 + 1, 1200), ' ') passage from n) select * from p where length(passage) >= 40""")
def passages(t: Tables) -> DataFrame:
    return T.passages(t.documents, most=None)


@query("""select doc_id, case when p > 0 then trim(regexp_replace(substr(text, greatest(p - 90, 1), p + 12 + 90 - greatest(p - 90, 1)), '\\s+', ' ', 'g'), ' ') end snippet from (select doc_id, text, instr(lower(text), 'licensed und') p from documents)""")
def haystack_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.snippet(F.col("text"), F.lit("licensed und")).alias("snippet"))


@query("""with q as (select vec_id query, embedding e from embeddings where vec_id % 100 = 0), s as (select query, vec_id, round(list_cosine_similarity(e::double[], embedding::double[]), 5) score, row_number() over (partition by query order by list_cosine_similarity(e::double[], embedding::double[]) desc, vec_id) rank from q, embeddings) select query, vec_id, score, rank from s where rank <= 10""")
def cosine_topk(t: Tables) -> DataFrame:
    return search.nearest(t.embeddings, t.embeddings.where("vec_id % 100 = 0")).select("query", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""with e as (select label as k, unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings), m as (select k, i, avg(x::double) x from e group by k, i), v as (select k, list(x order by i) c from m group by k) select a.k a, b.k b, round(list_cosine_similarity(a.c, b.c), 5) cos from v a join v b on a.k < b.k""")
def centroid_similar(t: Tables) -> DataFrame:
    c = search.centroid(t.embeddings, "label")
    x, y = c.select(F.col("label").alias("a"), F.col("centroid").alias("x")), c.select(F.col("label").alias("b"), F.col("centroid").alias("y"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 5).alias("cos"))


def _tfidf_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP)
    return f"""with w as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda v: length(v) >= 2 and v not in ({stop})) w from documents),
 t as (select doc_id, unnest(w) term from w union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w),
 c as (select doc_id, term, count(*) tf from t group by all), k as (select term, count(*) df from c group by term order by sum(tf) desc, term limit 6000),
 v as (select doc_id, term, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) x from c join k using (term)) select doc_id, term, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) w from v"""


@query(_tfidf_sql())
def tfidf_terms(t: Tables) -> DataFrame:
    return search.tfidf(t.documents, "doc_id", "text").withColumn("w", F.round("w", 6))


@query("""with k as (select user_id, list_sort(list_distinct(list(event_type))) x, list_sort(list_distinct(list(strftime(ts, '%a')))) d from events group by 1) select a.user_id a, b.user_id b, round(len(list_intersect(a.d, b.d)) / len(list_distinct(a.d || b.d)), 6) jaccard from k a join k b on b.user_id = a.user_id + 1""")
def jaccard_sets(t: Tables) -> DataFrame:
    k = t.events.groupBy("user_id").agg(F.collect_set(F.date_format("ts", "EEE")).alias("d"))
    y = k.select(F.col("user_id").alias("b"), F.col("d").alias("e"))
    return k.withColumnRenamed("user_id", "a").join(y, F.col("b") == F.col("a") + 1).select("a", "b", F.round(S.jaccard(F.col("d"), F.col("e")), 6).alias("jaccard"))


@query("""with p as (select p_partkey, p_name, substr(lower(p_name), 1, 6) block, p_brand from part) select x.p_partkey a, y.p_partkey b, cast(levenshtein(x.p_name, y.p_name) as int) d from p x join p y on x.block = y.block and x.p_brand = y.p_brand and x.p_partkey < y.p_partkey where levenshtein(x.p_name, y.p_name) <= 2""")
def fuzzy_block_match(t: Tables) -> DataFrame:
    """Distances are taken between different names of a block and brand; their parts come after, so that copies of a name are not compared again."""
    p = t.part.select("p_partkey", "p_name", F.substring(F.lower("p_name"), 1, 6).alias("block"), "p_brand")
    names = p.select("p_name", "block", "p_brand").distinct()
    x, y = names.withColumnRenamed("p_name", "na"), names.withColumnRenamed("p_name", "nb")
    near = x.join(y, ["block", "p_brand"]).select("na", "nb", "p_brand", F.levenshtein("na", "nb").alias("d")).where("d <= 2")
    a, b = (p.select(F.col("p_partkey").alias(k), F.col("p_name").alias(f"n{k}"), "p_brand") for k in "ab")
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many pairs, so they are not coalesced by size
    left = near.join(a, ["na", "p_brand"]).repartition(n, "nb", "p_brand")
    return left.join(b.repartition(n, "nb", "p_brand").hint("merge"), ["nb", "p_brand"]).where("a < b").select("a", "b", "d")


@query()
def fuzzy_scores(t: Tables) -> DataFrame:
    c = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", "c_name", "s_name")
    for k in S.SCORERS:
        c = S.scored(c, "c_name", "s_name", k, k)
    return c


def _catalogue_sql() -> str:
    rows = ", ".join(f"('{k}', '{c}', {g}::double)" for k, _, c, g in statutes.catalogue())
    same = ", ".join(f"('{a}', '{b}')" for a, b in statutes.equivalents().items())
    return f"cat(k, category, gravity) as (values {rows}), same(k, other) as (values {same})"


CITED = f"""{_catalogue_sql()}, cited as (select o_orderkey, 'IPC' act, cast(o_custkey % 520 as varchar) section, '' sub from orders union select o_orderkey, 'IPC', '34', '' from orders union select o_orderkey, 'IPC', '120B', '' from orders
 union select o_orderkey, 'NDPS', cast(o_orderkey % 40 as varchar), 'c' from orders union select o_orderkey, 'BNS', cast(o_custkey % 360 as varchar), case when o_custkey % 360 = 3 then '5' else '' end from orders),
 keyed as (select *, act || ':' || section bare, act || ':' || section || case sub when '' then '' else '(' || sub || ')' end key from cited),
 charged as (select o_orderkey, x.key, coalesce(e.category, w.category, case act when 'NDPS' then 'narcotics' else 'other' end) category, coalesce(e.gravity, w.gravity, case act when 'NDPS' then 0.7::double else 0.45::double end) gravity,
 case when e.k is null and w.k is null then 'act' else 'section' end basis, case when act in ('IPC', 'BNS') then coalesce(s.other, b.other) end equivalent from keyed x left join cat e on e.k = x.key left join cat w on w.k = x.bare left join same s on s.k = x.key left join same b on b.k = x.bare)"""


def cited(t: Tables) -> DataFrame:
    n, bns = (F.col("o_custkey") % 520).cast("string"), F.col("o_custkey") % 360
    last = F.concat(bns.cast("string"), F.when(bns == 3, "(5)").otherwise(""))
    text = F.concat(F.lit("u/s "), n, F.lit(" & sec. 34 r/w 120B I.P.C.; Section "), (F.col("o_orderkey") % 40).cast("string"), F.lit(" (C) NDPS Act; "), last, F.lit(" Bharatiya Nyaya Sanhita; 99; nothing of note"))
    return statutes.charges(t.orders.select("o_orderkey", text.alias("citation")), "o_orderkey", "citation")


@query(f"with {CITED} select * from charged")
def statute_charges(t: Tables) -> DataFrame:
    return cited(t).select("o_orderkey", "key", "category", "gravity", "basis", "equivalent")


@query(f"""with {CITED}, r as (select *, row_number() over (partition by o_orderkey order by case category when 'mode of liability' then 1 else 0 end, -gravity, key) k from charged)
 select o_orderkey, string_agg(key, ',' order by -gravity, key) keys, coalesce(string_agg(distinct category, ',' order by category) filter (category <> 'mode of liability'), '') categories, max(case k when 1 then key end) gravest, max(case k when 1 then gravity end) gravity from r group by 1""")
def charge_summary(t: Tables) -> DataFrame:
    s = statutes.summary(cited(t), "o_orderkey")
    return s.select("o_orderkey", F.array_join("keys", ",").alias("keys"), F.array_join("categories", ",").alias("categories"), "gravest", "gravity")


DAY = "cast(cast(o_orderdate as date) as string)"
DAY_FIRST = f"concat(substr({DAY}, 9, 2), '/', substr({DAY}, 6, 2), '/', substr({DAY}, 1, 4))"
ONE, TWO = "cast(o_custkey % 500 + 1 as string)", "cast(o_orderkey % 400 + 1 as string)"


@query(f"select o_orderkey, concat({DAY_FIRST}, ',', {DAY}) dates, case when {ONE} = {TWO} then {ONE} else concat({ONE}, ',', {TWO}) end sections from orders")
def dates_sections(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", F.expr(f"concat('FIR dated ', {DAY_FIRST}, ' and ', {DAY}, ' under section ', {ONE}, ', ', {TWO})").alias("raw"))
    return df.select("o_orderkey", F.array_join(T.dates(F.col("raw")), ",").alias("dates"), F.array_join(T.sections(F.col("raw")), ",").alias("sections"))


@query(f"""with x as (select o_orderkey, cast(cast(o_orderdate as date) as timestamp) d from orders) select o_orderkey, case o_orderkey % 4 when 0 then d + interval '10 hours 20 minutes 30 seconds' when 1 then d when 2 then d + interval '14 hours 5 minutes' end parsed from x""")
def datetime_parse(t: Tables) -> DataFrame:
    raw = f"case o_orderkey % 4 when 0 then concat({DAY}, 'T10:20:30Z') when 1 then {DAY_FIRST} when 2 then concat({DAY_FIRST}, ' 14:05') else o_orderpriority end"
    return t.orders.select("o_orderkey", K.parsed_time(F.expr(raw)).alias("parsed"))


@query("""select doc_id, len(regexp_extract_all(lower(text), 'idiot|moron|stupid'))::int hits from documents where regexp_matches(lower(text), 'idiot|moron|stupid')""")
def regex_row_filter(t: Tables) -> DataFrame:
    p = "idiot|moron|stupid"
    return t.documents.where(F.lower("text").rlike(p)).select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(p), 0)).alias("hits"))


@query()
def rule_ner(t: Tables) -> DataFrame:
    from ..plans.extract import mentions

    return mentions(t.documents)


NER_FIRST, NER_LAST = ("Rahul", "Sunita", "Imran", "Deepika", "Joseph"), ("Sharma", "Khan", "Fernandes", "Qureshi", "Patil", "Naik", "Bhosale")


def _pick(names, by: str) -> str:
    return f"case {by} % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


NAMED_BY = f"concat({_pick(NER_FIRST, 'o_custkey')}, ' ', {_pick(NER_LAST, 'o_orderkey')})"
NER_TEXT = f"""concat('On receipt of advance intelligence the ', case o_orderkey % 3 when 0 then 'accused ' when 1 then 'Shri ' else '' end, {NAMED_BY}, ' used mobile +91 9', lpad(cast(o_custkey % 10000 as string), 4, '0'), ' ', lpad(cast(o_orderkey % 100000 as string), 5, '0'),
 ' and A/c No. 00', lpad(cast(o_orderkey as string), 9, '7'), case when o_orderkey % 4 = 0 then ' of Silver Star Exports' else '' end, ', in Crime Branch Mumbai custody.')"""


@query(rf"""with x as (select o_orderkey, {NAMED_BY} who, lpad(cast(o_custkey % 10000 as varchar), 4, '0') p1, lpad(cast(o_orderkey % 100000 as varchar), 5, '0') p2, lpad(cast(o_orderkey as varchar), 9, '7') acc from orders)
 select o_orderkey doc_id, 'PERSON' as type, who as text, case o_orderkey % 3 when 0 then 'role' when 1 then 'title' else 'capitalised' end rule from x
 union all select o_orderkey, 'PHONE', '+91 9' || p1 || ' ' || p2, 'PHONE' from x union all select o_orderkey, 'BANK_ACCOUNT', '00' || acc, 'BANK_ACCOUNT' from x union all select o_orderkey, 'ORGANIZATION', 'Silver Star Exports', 'ORGANIZATION' from x where o_orderkey % 4 = 0""")
def named_mentions(t: Tables) -> DataFrame:
    from ..plans.extract import mentions

    return mentions(t.orders.select("o_orderkey", F.expr(NER_TEXT).alias("note")), doc_id="o_orderkey", text="note").select("doc_id", "type", "text", "rule")


@query(f"""select o_orderkey doc_id, 'PERSON' src_type, {NAMED_BY} src, 'DIRECTOR_OF' rel_type, 'ORGANIZATION' dst_type, 'Silver Star Exports' dst, 0.8::double confidence from orders where o_orderkey % 4 = 0""")
def relation_inference(t: Tables) -> DataFrame:
    from ..plans.extract import relations

    note = f"concat('On record: Shri ', {NAMED_BY}, case when o_orderkey % 4 = 0 then ' is director of Silver Star Exports.' else ' was not seen.' end)"
    return relations(t.orders.select("o_orderkey", F.expr(note).alias("note")), doc_id="o_orderkey", text="note")


@query()
def sentence_split(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


QUOTE = "case turn % 3 when 0 then concat(' ', substr(text, 3, 30)) when 1 then concat('zz', substr(text, 1, 10)) end"


@query(f"""with x as (select conv_id, turn, text, {QUOTE} quote from conversations), y as (select *, lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')) b, lower(regexp_replace(quote, '[ \t\n\x0B\f\r]+', '', 'g')) q from x) select conv_id, turn, coalesce(length(q) > 0 and contains(b, q), false) ok from y""")
def grounding_check(t: Tables) -> DataFrame:
    from ..plans.extract import grounded

    return t.conversations.select("conv_id", "turn", grounded(F.col("text"), F.expr(QUOTE)).alias("ok"))


#: Words of these texts in place of the vocabulary of offences.
FINDINGS = {"approach": {"form": ("http", "www"), "list": ("und", "von")}, "control": {"restraint": ("tied",)}, "scene": {"ordered": ("license",), "disordered": ("ing",)}, "signature": {"insult": ("idiot",), "dislike": ("stupid",), "licence": ("license",), "rights": ("rights",)}}


def _linkage_sql() -> str:
    mask = lambda table: " + ".join(f"case when regexp_matches(x, '{linkage.phrases(w)}') then {1 << k} else 0 end" for k, w in enumerate(table.values()))
    count = lambda g: f"len(regexp_extract_all(x, '{linkage.phrases(linkage.GENDER[g])}'))"
    shared = lambda c: f"case when a.{c} | b.{c} <> 0 then bit_count(a.{c} & b.{c})::double / bit_count(a.{c} | b.{c}) end"
    mean = lambda parts: f"coalesce(list_avg(list_filter([{', '.join(parts)}], lambda v: v is not null)), 0)"
    same = lambda c: f"case when a.{c} is not null and b.{c} is not null then (a.{c} = b.{c})::int::double end"
    near = "case when a.age > 0 and b.age > 0 then greatest(0::double, 1 - abs(a.age - b.age) / 25::double) end"
    stop = ", ".join(f"'{w}'" for w in search.STOP)
    # there a word boundary knows ASCII only
    return f"""with d as (select doc_id, coalesce(text, '') x from documents), y as (select doc_id, regexp_replace(x, '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{24F}}]', 'q', 'g') x from d), f as (select doc_id, {', '.join(f'{mask(v)} as {k}' for k, v in FINDINGS.items())},
  case when {count('female')} + {count('male')} > 0 then case when {count('female')} >= {count('male')} then 'female' else 'male' end end gender,
  try_cast(regexp_extract(regexp_extract(x, '(?i)\\bage[d]?\\s*(?:about\\s*)?[0-9]{{1,2}}\\b|[(][0-9]{{1,2}}\\s*(?:yr|year)s?[)]'), '[0-9]+') as int) age, nullif(lower(regexp_extract(x, '{linkage.phrases(linkage.OCCUPATIONS)}')), '') occupation from y),
 w as (select doc_id, list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+'), lambda v: length(v) >= 2 and v not in ({stop})) w from d),
 t as (select doc_id, unnest(w) term from w union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w),
 c as (select doc_id, term, count(*) tf from t group by all), k as (select term, count(*) df from c group by term order by sum(tf) desc, term limit 6000),
 v as (select doc_id, term, tf * (ln((1 + (select count(*) from d)) / (1 + df)) + 1) x from c join k using (term)), u as (select doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) w from v),
 p as (select a.doc_id a, b.doc_id b, 0.4::double * coalesce({shared('signature')}, 0) + 0.2::double * {mean([same('gender'), near, same('occupation')])} + 0.15::double * {mean([shared('approach'), shared('control'), shared('scene')])} s
  from f a join f b on a.doc_id < b.doc_id), q as (select * from p where s >= 0.2999), z as (select q.a, q.b, sum(x.w * y.w) cos from q join u x on x.doc_id = q.a join u y on y.doc_id = q.b and y.term = x.term group by all),
 l as (select q.a, q.b, round(s + 0.25::double * coalesce(cos, 0), 4) score from q left join z on z.a = q.a and z.b = q.b), links as (select *, score >= 0.72 strong from l where score >= 0.55)"""


def _case_links(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = linkage.features(t.documents, "doc_id", "text", FINDINGS)
    weights = search.tfidf(t.documents, "doc_id", "text").withColumnRenamed("doc_id", "case_id")
    return written(linkage.links(found, weights, vocabulary=FINDINGS).select("a", "b", "score", "strong"), "case_links"), found


@query(_linkage_sql() + " select * from links")
def case_linkage(t: Tables) -> DataFrame:
    return _case_links(t)[0].select("a", "b", "score", "strong")


@query(_linkage_sql().replace("with d as", "with recursive d as", 1) + """, bw as (select a u, b v from links union select b, a from links), r(id, s) as (select u, u from bw union select v, s from r join bw on u = id),
 g as (select id, min(s) series from r group by id), n as (select series, count(*) n from g group by series), m as (select series, avg(score) cohesion from links join g on g.id = a group by series),
 e as (select series, bit_and(signature) common, list_sort(list_distinct(list(gender) filter (gender is not null))) genders from g join f on f.doc_id = id group by series)
 select series, n as size, round(cohesion, 6) cohesion, array_to_string(list_filter(['dislike', 'insult', 'licence', 'rights'], lambda x: (common & case x when 'insult' then 1 when 'dislike' then 2 when 'licence' then 4 else 8 end) <> 0), ',') common_signature from n join m using (series) join e using (series)""")
def case_series(t: Tables) -> DataFrame:
    linked, found = _case_links(t)
    out = linkage.series(linked, found, vocabulary=FINDINGS)
    return out.select("series", "size", F.round("cohesion", 6).alias("cohesion"), F.array_join("common_signature", ",").alias("common_signature"))


@query("""with p as (select doc_id, cast(n as int) n, length(passage) % 97 score from (select doc_id, n, trim(substr(text, n * 1200 + 1, 1200), ' ') passage from (select doc_id, text, unnest(range(greatest(1, cast(ceil(length(text) / 1200.0) as int)))) n from documents)) where length(passage) >= 40),
 r as (select *, row_number() over (partition by doc_id order by score desc, n) k from p) select doc_id, n, cast(score as int) score from r where k = 1 order by score desc, doc_id limit 20""")
def best_passage(t: Tables) -> DataFrame:
    from ..plans.outliers import best_passage as best

    return best(T.passages(t.documents, most=None).select("doc_id", "n", (F.length("passage") % 97).alias("score")))


@query()
def mention_function(t: Tables) -> DataFrame:
    """The SQL table function over rows."""
    from ..plans.tools import register_functions

    register_functions(t.spark)
    t.conversations.createOrReplaceTempView("turns")
    return t.spark.sql("select conv_id, turn, m.* from turns, lateral mentions_of(text) m")


LABELS = {"ARTICLE": ("the", "la", "der"), "LINK": ("and", "und", "et"), "OF": ("of", "de")}
_COUNTED = ", ".join(f"cast(sum(len(regexp_extract_all(x, '(?i)\\b(?:{'|'.join(w)})\\b'))) as int) as {k}" for k, w in LABELS.items())


@query(f"""with x as (select conv_id, regexp_replace(coalesce(text, ''), '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{24F}}]', 'q', 'g') x from conversations) select conv_id, cast(count(*) as int) as rows, {_COUNTED} from x group by conv_id""")
def labelled_conversations(t: Tables) -> DataFrame:
    """A table function whose columns are the labels of the call."""
    from ..plans.tools import register_functions

    register_functions(t.spark)
    t.conversations.select("conv_id", "text").createOrReplaceTempView("turns_of_text")
    labels = "; ".join(f"{k}: {', '.join(w)}" for k, w in LABELS.items())
    return t.spark.sql(f"select * from labelled(table(turns_of_text) partition by conv_id, text => 'text', labels => '{labels}')")
