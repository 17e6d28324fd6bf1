"""DuckDB SQL of the longer oracles, put together from parts."""

from __future__ import annotations

#: One row with ``t``: the 256 remainders of the CRC-32 polynomial.
CRC_TABLE = """crc as (select list(c order by i) as t from (select i,
 list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) as c from range(256) r(i)))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string expression; ``crc`` must be joined in."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::bigint)"
    return (f"xor(list_reduce([4294967295::bigint] || {codes}, "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _leaf(text: str) -> str:
    cols = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(
        f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end" for c in cols) + ")"


def _tree(name: str, rows: str, levels: int) -> str:
    """CTEs from ``rows`` (grp, idx, node, fold, proof), one per member of a tree: ``<name>`` has
    the same after ``levels`` levels at most, with the tree's root as ``node`` and the last ``fold``."""
    parts, last = [], rows
    for k in range(levels):
        up, now = f"{name}_u{k}", f"{name}_{k}"
        # a node per run of three; a tree of one node stays
        parts.append(f"""{up} as (select grp, idx // 3 as idx, string_agg(node, '' order by idx) as body, count(*) as n,
 list(node order by idx) as nodes, max(count(*)) over (partition by grp) as most, count(*) over (partition by grp) as runs
 from (select distinct grp, pos as idx, node from {last}) group by grp, idx // 3)""")
        one = "u.runs = 1 and u.most = 1"
        left, right = "array_to_string(u.nodes[1:r.pos % 3], '')", "array_to_string(u.nodes[r.pos % 3 + 2:], '')"
        parts.append(f"""{now} as (select r.* exclude (pos, node, fold, proof), case when {one} then r.pos else r.pos // 3 end as pos,
 case when {one} then r.node else sha256(u.body) end as node,
 case when {one} then r.fold else sha256({left} || r.fold || {right}) end as fold,
 case when {one} then r.proof else r.proof || {left} || {right} end as proof
 from {last} r join {up} u on r.grp is not distinct from u.grp and r.pos // 3 = u.idx)""")
        last = now
    return ",\n".join(parts) + f",\n{name} as (select * from {last})"


#: Holds up to 3 ** 13 rows of a source and 3 ** 6 sources.
MERKLE = f"""with {CRC_TABLE},
c as (select *, {crc32("doc_id::varchar")} as crc32 from documents, crc),
leaves as (select doc_id, source as grp, {_leaf("text")} as leaf,
 case when crc32 % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as fold from c),
base as (select *, leaf as node, '' as proof,
 row_number() over (partition by grp order by doc_id nulls first, leaf, fold) - 1 as pos from leaves),
{_tree("sub", "base", 13)},
subs as (select grp as source, node as subroot, row_number() over (order by grp nulls first) - 1 as at
 from (select distinct grp, node from sub)),
bases as (select s.doc_id, s.leaf, s.node as subroot, 1 as grp, q.at as pos, s.node, s.fold, s.proof
 from sub s join subs q on s.grp is not distinct from q.source),
{_tree("whole", "bases", 6)}
select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = node as verified from whole"""


#: Stretches of each period by gaps and islands over pairs of equal words; the smallest period of a stretch stays.
RUNS = f"""with {CRC_TABLE},
d as (select doc_id, row_number() over () as row, {crc32("coalesce(doc_id, 0)::varchar")} as h,
 doc_id is not null as known, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents, crc),
m as (select *, len(w) as n, h // 10 as g, known and h % 10 = 0 and len(w) > 0 as hit from d),
ap as (select *, case when hit then g % n end as a, case when hit then 1 + (n - g % n) // (3 + g % 8) end as p from m),
t as (select row, doc_id, n, case when hit then list_transform(range(n), lambda i: w[case when i < a then i + 1 else a + (i - a) % p + 1 end])
 else w end as w from ap),
e as (select row, n, unnest(w) as x, unnest(range(n)) as i from t),
eq as (select a.row, b.i - a.i as q, a.i from e a join e b on a.row = b.row and a.x = b.x and b.i > a.i and (b.i - a.i) * 4 <= a.n),
isl as (select row, q, min(i) as start, count(*) + q as length from
 (select *, i - row_number() over (partition by row, q order by i) as k from eq) group by row, q, k),
runs as (select row, start, length, min(q) as period from isl where length >= greatest(6, 4 * q) group by row, start, length),
best as (select row, start, length, period from runs qualify row_number() over (
 partition by row order by length::decimal(18, 0) * 1000000000000 // period desc, start, period) = 1),
lists as (select row, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as s from runs group by row),
gone as (select distinct e.row, e.i from e join runs r on e.row = r.row and e.i >= r.start + r.period and e.i < r.start + r.length),
kept as (select row, string_agg(x, ' ' order by i) as s from e anti join gone using (row, i) group by row)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
 sha256(coalesce(l.s, '')) as runs_sha256, sha256(coalesce(k.s, '')) as collapsed_sha256
from t left join lists l using (row) left join best using (row) left join kept k using (row)"""


_WORDS = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def _values(rows) -> str:
    return ", ".join("('" + "', '".join(x.replace("'", "''") for x in r) + "')" for r in rows)


def licenses(phrases, notices, threshold: float) -> str:
    """Every phrase at every place, and every block against every notice."""
    return f"""with d as (select row_number() over () as row, doc_id, {_WORDS.format("text")} as w from documents),
ph as (select label, {_WORDS.format("p")} as p from (values {_values(phrases)}) v(label, p)),
pl as (select row, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) as place from d, ph),
base as (select row, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_sort(list(distinct label)) as labels
 from pl group by row),
no as (select label, list_distinct({_WORDS.format("p")}) as own,
 greatest(16, pow(2, ceil(log2(2 * len({_WORDS.format("p")}))))::bigint) as size from (values {_values(notices)}) v(label, p)),
bl as (select row, size, w[b + 1:b + size] as words from (select row, w, size, unnest(range(0, greatest(len(w) - size // 2, 1), size // 2)) as b
 from d, (select distinct size from no))),
me as (select row, label, len(list_intersect(list_distinct(words), own)) / len(own)::double as share from bl join no using (size)),
found as (select row, list(distinct label) as labels, max(share) as share from me where share >= {threshold} - 1e-9 group by row)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
 coalesce(array_to_string(b.labels, ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') as labels,
 case when n_base > 0 then 1.0 else coalesce(share, 0) end::double as score
from d left join base b using (row) left join found f using (row)"""
