"""The queries of this subpackage that SQL can express, for DuckDB."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON ends.a = reach.to_id),
m AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first != page_id THEN first END AS refers_to
FROM f
"""


def _kind(order: int, name: str, pattern: str, valid: str) -> str:
    return (
        f"SELECT doc_id, '{name}' AS kind, {order} AS k, s, s + length(hit) AS e, text FROM (SELECT doc_id, text, hit, CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) - length(hit) AS s "
        f"FROM (SELECT doc_id, text, unnest(string_split_regex(text, '{pattern}')) AS gap, unnest(regexp_extract_all(text, '{pattern}')) AS hit, unnest(range(len(string_split_regex(text, '{pattern}')))) AS n FROM t WHERE regexp_matches(text, '{pattern}'))) "
        f"WHERE hit IS NOT NULL AND {valid}"
    )


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: (CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) ELSE (2 * CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT)) % 10 + (2 * CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT)) // 10 END))) % 10 = 0"
_MOVED = "(substr(replace(hit, ' ', ''), 5) || substr(hit, 1, 4))"
_NUMBER = f"list_aggregate(list_transform(string_split({_MOVED}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '')"


def _mod_97(digits: str) -> str:
    """The remainder of up to 68 digits, in steps that fit 128 bits."""
    rest = f"CAST(CAST(substr({digits}, 1, 30) AS HUGEINT) % 97 AS VARCHAR)"
    rest = f"CAST(CAST({rest} || substr({digits}, 31, 20) AS HUGEINT) % 97 AS VARCHAR)"
    return f"CAST({rest} || substr({digits}, 51) AS HUGEINT) % 97"


_IBAN = _kind(5, "iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", f"{_mod_97(_NUMBER)} = 1")

OP2 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
{_kind(1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', 'true')}
UNION ALL {_kind(2, 'ip', '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)', "len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0")}
UNION ALL {_kind(3, 'card', '[0-9]([\\x20-]?[0-9])+', f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")}
UNION ALL {_kind(4, 'phone', '\\+[0-9][\\x20().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 9 AND 15")}),
ssn AS (SELECT doc_id, kind, k, s, e FROM ({_kind(6, 'ssn', '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b', "NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$')")}) WHERE regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0))), 'ssn|social|security') AND NOT regexp_matches(substr(text, s, 1) || substr(text, e + 1, 1), '-')),
iban AS ({_IBAN}),
spans AS (SELECT doc_id, kind, k, s, e FROM base UNION ALL SELECT doc_id, kind, k, s, e FROM iban UNION ALL SELECT * FROM ssn),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY k, s) FILTER (k <= 4) AS b, string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY k, s) AS a FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""

# CRC-32 of the decimal of {c}: a table of the 256 bytes' remainders, then byte after byte.
_CRC_TABLE = "crc_table as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) as t)"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({c}::varchar, ''), lambda b: ascii(b)::bigint)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)))"

OP12 = f"""
with {_CRC_TABLE},
turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
    strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':' || coalesce(text, '') as u, strlen(coalesce(text, '')) as size from conversations where conv_id is not null),
convs as (select c.conv_id, {_CRC.format(c="c.conv_id")} % 9 as h, c.conv_id - c.conv_id % 5 as donor from (select distinct conv_id from turns) c, crc_table),
made as (select c.conv_id, 0 as own, d.i, d.u, d.size from convs c join turns d on d.conv_id = c.donor and d.i <= c.h
    union all select c.conv_id, 1, d.i, d.u, d.size from convs c join turns d on d.conv_id = c.conv_id and d.i > c.h),
placed as (select conv_id, row_number() over (partition by conv_id order by own, i) as depth, u, size from made),
paths as (select conv_id, depth, size, string_agg(u, '') over (partition by conv_id order by depth) as prefix from placed
    union all select conv_id, 0, 0, '' from convs),
lengths as (select conv_id, max(depth) as n from paths group by conv_id),
nodes as (select depth, prefix, min(p.conv_id) as node, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (where depth = n), '')) as ends from paths p join lengths l on p.conv_id = l.conv_id group by depth, prefix),
members as (select p.conv_id, n.depth, n.node from paths p join nodes n on p.depth = n.depth and p.prefix = n.prefix),
linked as (select n.*, m.node as parent from nodes n left join members m on m.conv_id = n.node and m.depth = n.depth - 1),
children as (select parent, depth - 1 as depth, count(*) as n from linked where depth > 0 group by parent, depth),
full_nodes as (select l.*, coalesce(c.n, 0) as n_children from linked l left join children c on c.parent = l.node and c.depth = l.depth),
sums as (select m.node, m.depth, sum((f.n_children = 0)::int) as leaves, sum((f.n_convs - 1) * f.size) as saved from full_nodes f join members m on m.conv_id = f.node and m.depth <= f.depth group by m.node, m.depth)
select f.node as conv_id, f.depth::bigint as depth, f.parent as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
    s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, f.ends as ends_sha256
from full_nodes f join sums s on s.node = f.node and s.depth = f.depth
"""

_LEAF = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = f"""
with recursive {_CRC_TABLE},
leaves as (select doc_id, source, sha256({_LEAF.format(text="text")}) as leaf,
    case when {_CRC.format(c="doc_id")} % 5 = 0 then sha256({_LEAF.format(text=_LOWERED)}) end as other from documents, crc_table),
placed as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 as pos, count(*) over (partition by source) as size from leaves),
levels as (select source, 0 as level, pos, leaf as h, size from placed
    union all select source, level + 1, pos // 16, sha256(string_agg(h, '' order by pos)), any_value((size + 15) // 16) from levels where size > 1 group by source, level, pos // 16),
groups as (select source, h as subroot, level as depth, row_number() over (order by source nulls first) - 1 as place, count(*) over () as size from levels where size = 1),
tops as (select 0 as level, place as pos, subroot as h, size from groups
    union all select level + 1, pos // 16, sha256(string_agg(h, '' order by pos)), any_value((size + 15) // 16) from tops where size > 1 group by level, pos // 16),
nodes as (select l.source, l.level, l.pos, l.h, l.size from levels l where size > 1
    union all select g.source, g.depth + t.level, t.pos, t.h, t.size from tops t, groups g where t.size > 1),
runs as (select source, level, pos // 16 as run, list(h order by pos) as hs, any_value(size) as size from nodes group by source, level, pos // 16),
walk as (select p.doc_id, p.source, p.leaf, coalesce(p.other, p.leaf) as h, p.pos, 0 as level, '' as proof, g.depth, g.place, g.subroot from placed p join groups g on p.source is not distinct from g.source
    union all select doc_id, w.source, leaf, sha256(array_to_string(list_slice(hs, 1, k), '') || h || array_to_string(list_slice(hs, k + 2, len(hs)), '')), at_pos // 16, w.level + 1,
        proof || array_to_string(list_slice(hs, 1, k), '') || array_to_string(list_slice(hs, k + 2, len(hs)), ''), depth, place, subroot
    from (select *, case when level = depth then place else pos end as at_pos, (case when level = depth then place else pos end) % 16 as k from walk) w
    join runs r on w.source is not distinct from r.source and w.level = r.level and r.run = at_pos // 16),
top as (select h as root from tops where size = 1),
ended as (select *, row_number() over (partition by source, doc_id, leaf order by level desc) as nth from walk)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from ended, top where nth = 1
"""
