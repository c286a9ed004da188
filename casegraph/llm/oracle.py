"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .mixing import DIMENSIONS


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes over crc_table.t, a table made from the polynomial."""
    code = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: cast('0x' || substr(hex(encode({text})), i, 2) as ubigint))"
    step = "lambda c, b: xor(c >> 8, t[cast(xor(c & 255, b) + 1 as bigint)])"
    return f"cast(xor(list_reduce({code}, {step}, 4294967295::ubigint), 4294967295::ubigint) as bigint)"


CRC_TABLE = "crc_table as (select list(c order by i) t from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, i::ubigint) c from range(256) r(i)))"

SHARDING = f"""with {CRC_TABLE}, s as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) size, {crc32_sql("coalesce(text, '')")} text_crc32 from documents, crc_table),
 p as (select *, sum(size) over (order by doc_id rows between unbounded preceding and current row) upto, sum(size) over () total from s), t as (select *, cast(least(7, floor((2 * upto - size) * 4.0::double / total)) as int) shard from p)
 select doc_id, size, text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by doc_id) - 1 slot, null::int grown_shard from t"""


_RECORD = " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))

#: One recursion a step: the levels of each language, the levels over the languages, the way of each leaf up its language, and up to the root.
MERKLE = f"""with recursive {CRC_TABLE}, d as (select *, {crc32_sql("cast(doc_id as varchar)")} % 7 = 0 touched from documents, crc_table),
 l as (select doc_id, lang, sha256({_RECORD.format(n="n_chars")}) leaf, case when touched then sha256({_RECORD.format(n="(n_chars + 1)")}) end changed from d),
 p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from l),
 t as (select lang, 0::bigint k, pos, n, leaf h from p union all
  select lang, k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by lang, k, pos // 2, n),
 s as (select lang, h subroot, row_number() over (order by lang nulls first) - 1 pos, count(*) over () n from t where n = 1),
 u as (select 0::bigint k, pos, n, subroot h from s union all select k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from u where n > 1 group by k, pos // 2, n),
 a as (select doc_id, lang, leaf, 0::bigint k, pos, n, '' proof, coalesce(changed, leaf) acc from p union all
  select doc_id, a.lang, leaf, a.k + 1, a.pos // 2, (a.n + 1) // 2, proof || coalesce(h, ''), sha256(case when a.pos % 2 = 1 then h || acc else acc || coalesce(h, '') end)
  from a left join t on t.lang is not distinct from a.lang and t.k = a.k and t.pos = xor(a.pos, 1) where a.n > 1),
 b as (select doc_id, leaf, subroot, 0::bigint k, s.pos, s.n, proof, acc from a join s on s.lang is not distinct from a.lang where a.n = 1 union all
  select doc_id, leaf, subroot, b.k + 1, b.pos // 2, (b.n + 1) // 2, proof || coalesce(h, ''), sha256(case when b.pos % 2 = 1 then h || acc else acc || coalesce(h, '') end)
  from b left join u on u.k = b.k and u.pos = xor(b.pos, 1) where b.n > 1)
 select doc_id, leaf, subroot, h root, sha256(proof) proof_sha256, acc folded_root, acc = h verified from b, (select h from u where n = 1) where b.n = 1"""


#: Nodes are sequences of turns' digests, as one text; subtrees are found by the paths of their nodes' smallest members.
TRIE = f"""with {CRC_TABLE}, o as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 i from conversations where conv_id is not null),
 c as (select conv_id, conv_id - conv_id % 5 base, {crc32_sql("cast(conv_id as varchar)")} % 9 h from (select distinct conv_id from o), crc_table),
 b as (select c.conv_id, 0 own, i, r, x from c join o on o.conv_id = base where i < h union all select c.conv_id, 1, i, r, x from c join o using (conv_id) where i >= h),
 d as (select conv_id, row_number() over (partition by conv_id order by own, i) d, octet_length(encode(x))::bigint y, sha256(octet_length(encode(r)) || ':' || r || x) g from b),
 p as (select conv_id, d, y, string_agg(g, '') over (partition by conv_id order by d rows unbounded preceding) k, count(*) over (partition by conv_id) len from d
  union all select conv_id, 0, 0::bigint, '', (select count(*) from d where d.conv_id = c.conv_id) from c),
 n as (select k, d, min(conv_id) conv_id, count(*)::bigint n, max(y) y, string_agg(case when d = len then conv_id::varchar end, ',' order by conv_id) ends from p group by k, d),
 m as (select n.*, p.k up from n left join p on p.conv_id = n.conv_id and p.d = n.d - 1), ch as (select up k, count(*) n from m where up is not null group by up),
 f as (select m.*, coalesce(ch.n, 0)::bigint children from m left join ch using (k)),
 s as (select p.k, sum((f.n - 1) * f.y)::bigint saved, count(*) filter (f.children = 0)::bigint leaves from f join p on p.conv_id = f.conv_id and p.d <= f.d group by p.k)
 select f.conv_id, f.d::bigint depth, u.conv_id parent_conv_id, f.n n_convs, f.children n_children, s.leaves n_leaves, s.saved saved_tokens, sha256(coalesce(f.ends, '')) ends_sha256
 from f join s using (k) left join f u on u.k = f.up"""


def mixing_sql(sweeps: int = 12, keep: float = 0.5, flatten: float = 0.5) -> str:
    """The sweeps as one common table expression each."""
    share = ", ".join(f"pow(sum(tokens) over (partition by {d})::double, {flatten}) p_{d}" for d in DIMENSIONS)
    totals = ", ".join(f"(select sum(x) from (select distinct {d}, pow(sum(tokens) over (partition by {d})::double, {flatten}) x from cells)) a_{d}" for d in DIMENSIONS)
    steps, last = [], "w0"
    for i in range(sweeps):
        for k, d in enumerate(DIMENSIONS):
            name = f"w{3 * i + k + 1}"
            steps.append(f"{name} as (select * exclude (w), case when sum(w) over (partition by {d}) > 0 then w * (p_{d} / a_{d}) * total / sum(w) over (partition by {d}) else 0 end w from {last})")
            last = name
    return f"""with d as (select *, coalesce(source, '(none)') s, coalesce(lang, '(none)') l, case when contains(text, ' | ') then 'table' when contains(text, '@') then 'contact' when length(text) < 1000 then 'note' when length(text) < 4000 then 'article' else 'long' end topic,
 cast(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) as bigint) tokens from documents), cells as (select s as source, l as lang, topic, sum(tokens)::bigint tokens from d group by all), w0 as (select *, tokens::double w, sum(tokens) over ()::double total, {share}, {totals} from cells),
 {', '.join(steps)}, r as (select source, lang, topic, tokens, w, w / tokens ratio, total, row_number() over (order by w / tokens desc, source, lang, topic) k from {last}),
 c as (select *, ({keep} * total - coalesce(sum(tokens) over (order by k rows between unbounded preceding and 1 preceding), 0)) / (sum(w) over () - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0)) c from r),
 f as (select max(c) factor from c where c * ratio <= 1 and c > 0), m as (select source, lang, topic, ratio, least(1.0, factor * ratio) p from c, f)
 select doc_id, d.source, d.lang, d.topic, d.tokens, round(ratio, 6) weight, round(p, 6) probability, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as ubigint)::double / 4294967296 < p sampled from d join m on m.source = d.s and m.lang = d.l and m.topic = d.topic"""
