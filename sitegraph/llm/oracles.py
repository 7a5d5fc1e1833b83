"""DuckDB text of the queries whose statement is built from parts."""

from __future__ import annotations

from sitegraph.llm.common import LOWER, UPPER


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: the reflected polynomial, a bit at a time."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {letters}), lambda c, b: {step}))"


def merkle_sql(levels: int = 8, crown_levels: int = 5) -> str:
    """Trees of up to 16^levels leaves under a crown of up to 16^crown_levels groups; higher levels change nothing."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]

    def leaf(last):
        parts = [f"cast({f} as varchar)" for f in fields[:-1]] + [last]
        return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"

    out = [f"""d as (select doc_id, source, row_number() over () as rid, {leaf('text')} as leaf,
      case when {crc32_sql('cast(doc_id as varchar)')} % 5 = 0
           then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as other from documents),
t0 as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
              count(*) over (partition by source) as n, leaf as h from d),
p0 as (select rid, source as tree, pos, '' as proof, coalesce(other, leaf) as cur from t0)"""]

    def climb(t, p, top, tree):
        for k in range(top):
            out.append(f"""{t}{k + 1} as (select {tree}, pos // 16 as pos, (max(n) + 15) // 16 as n,
        case when max(n) > 1 then sha256(string_agg(h, '' order by pos)) else max(h) end as h from {t}{k} group by {tree}, pos // 16),
{p}{k + 1} as (select p.rid, p.tree, p.pos // 16 as pos,
        any_value(p.proof) || coalesce(string_agg(t.h, '' order by t.pos) filter (where t.pos <> p.pos), '') as proof,
        case when max(t.n) > 1 then sha256(string_agg(case when t.pos = p.pos then p.cur else t.h end, '' order by t.pos))
             else any_value(p.cur) end as cur
      from {p}{k} p join {t}{k} t on p.tree is not distinct from t.{tree} and t.pos // 16 = p.pos // 16 group by p.rid, p.tree, p.pos)""")

    climb("t", "p", levels, "source")
    out.append(f"""s0 as (select 0 as one, source, row_number() over (order by source nulls first) - 1 as pos,
               count(*) over () as n, h from t{levels}),
q0 as (select rid, 0 as tree, s0.pos, proof, cur from p{levels} p join s0 on p.tree is not distinct from s0.source)""")
    climb("s", "q", crown_levels, "one")
    return "with " + ", ".join(out) + f"""
select d.doc_id, d.leaf, s0.h as subroot, r.h as root, sha256(q.proof) as proof_sha256, q.cur as folded_root, q.cur = r.h as verified
from d join q{crown_levels} q on d.rid = q.rid join s0 on d.source is not distinct from s0.source cross join s{crown_levels} r"""


def trie_sql(heads: int = 6, every: int = 100) -> str:
    """Rebuilt conversations as lists of turns, every prefix as text, subtree sums over the prefixes of a node's least member."""
    return f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn nulls first,
                    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
           from conversations where conv_id is not null),
l as (select conv_id, list(sha256(strlen(role) || ':' || role || text) order by place) as turns, list(length(text) order by place) as lens
      from t group by conv_id),
c as (select l.conv_id, {crc32_sql('cast(l.conv_id as varchar)')} % {heads} as h, l.turns, l.lens, b.turns as bt, b.lens as bl
      from l left join l b on b.conv_id = l.conv_id - l.conv_id % {every}),
r as (select conv_id, list_concat(coalesce(bt, [])[1:h], turns[h + 1:]) as turns, list_concat(coalesce(bl, [])[1:h], lens[h + 1:]) as lens from c),
m as (select conv_id, len(turns) as n, d, sha256(array_to_string(turns[1:d], ',')) as key, sha256(array_to_string(turns[1:d - 1], ',')) as up,
             coalesce(lens[d], 0) as len from (select *, unnest(range(len(turns) + 1)) as d from r)),
u as (select key, d, min(conv_id) as conv_id, any_value(up) as up, any_value(len) as len, count(*) as n_convs,
             sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = d), '')) as ends
      from m group by key, d),
k as (select up as key, d - 1 as d, count(*) as n_children from u where d > 0 group by up, d),
s as (select m.key, m.d, count(*) filter (where k.n_children is null) as n_leaves, sum((u.n_convs - 1) * u.len) as saved
      from u left join k on u.key = k.key and u.d = k.d join m on m.conv_id = u.conv_id and m.d <= u.d group by m.key, m.d)
select u.conv_id, cast(u.d as bigint) as depth, p.conv_id as parent_conv_id, u.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves,
       cast(s.saved as bigint) as saved_tokens, u.ends as ends_sha256
from u join s on u.key = s.key and u.d = s.d left join k on u.key = k.key and u.d = k.d
     left join u p on u.d > 0 and p.key = u.up and p.d = u.d - 1"""


def substring_sql(length: int = 35) -> str:
    """Every window as the digest of its words; words that a repeated one covers go."""
    return f"""
with w as (select doc_id, row_number() over () as rid,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select rid, ws, unnest(range(1, len(ws) - {length} + 2)) as p from w),
h as (select rid, p, md5(array_to_string(ws[p:p + {length - 1}], ' ')) as h from s),
r as (select rid, p from (select *, count(*) over (partition by h) as n from h) where n > 1),
g as (select distinct rid, p + unnest(range({length})) as p from r),
k as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
a as (select k.rid, count(*) filter (where g.p is not null) as n_removed, string_agg(word, ' ' order by k.p) filter (where g.p is null) as kept
      from k left join g on k.rid = g.rid and k.p = g.p group by k.rid)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, coalesce(a.n_removed, 0) as n_removed, sha256(coalesce(a.kept, '')) as kept_sha256
from w left join a on w.rid = a.rid"""
