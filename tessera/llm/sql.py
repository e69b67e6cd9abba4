"""DuckDB SQL that equals some of this subpackage's queries."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: a fold over them with the table of remainders of single bytes."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    digits = f"hex(encode({text}))"
    steps = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::int::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda c, b: xor(c >> 8, ({table}::bigint[])[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


def sharding_sql(shards: int = 8, bits: int = 6) -> str:
    """Rows by size, language and source along the Hilbert curve, cut into runs of equal counts."""
    # Entry corners and directions of the sub-cells of a three-dimensional Hilbert curve, as published for compact Hilbert indices.
    entries, directions = [0, 0, 0, 3, 3, 6, 6, 5], [0, 1, 1, 2, 2, 1, 1, 0]
    depth = lambda c: f"cast((select count(*) from d o where o.{c} < d.{c}) * {1 << bits} // (select count(*) from d) as bigint)"
    steps = "select *, 0::bigint as h, 0::bigint as e, 0::bigint as k from cells"
    for i in reversed(range(bits)):
        corner = " | ".join(f"(((x{j} >> {i}) & 1) << {j})" for j in range(3))
        turn = "((k + 1) % 3)"
        steps = f"select * exclude (v), ((v >> {turn}) | (v << (3 - {turn}))) & 7 as v from (select *, xor({corner}, e) as v from ({steps}))"
        steps = f"select * exclude (v), xor(xor(v, v >> 1), v >> 2) as v from ({steps})"
        entry = f"({entries}::bigint[])[v + 1]"
        steps = f"select * exclude (h, e, k, v), h * 8 + v as h, xor(e, (({entry} << {turn}) | ({entry} >> (3 - {turn}))) & 7) as e, (k + ({directions}::bigint[])[v + 1] + 1) % 3 as k from ({steps})"
    return f"""with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
        sized as (select *, octet_length(encode(t)) + 1 as size, {crc32_sql("t")} as text_crc32 from d),
        cells as (select doc_id, size, text_crc32, least({(1 << bits) - 1}, (length(bin(size)) - 1) * 2 + case when length(bin(size)) > 1 then (size >> (length(bin(size)) - 2)) & 1 else 0 end)::bigint as x0,
            {depth("lang").replace("d.lang", "s.lang")} as x1, {depth("source").replace("d.source", "s.source")} as x2 from sized s),
        placed as (select doc_id, size, text_crc32, row_number() over (order by h, doc_id, text_crc32, size) - 1 as r, count(*) over () as n from ({steps}))
        select doc_id, size, text_crc32, 'rows' as law, cast(r * {shards} // n as int) as shard, r - ((r * {shards} // n) * n + {shards - 1}) // {shards} as slot, cast(null as int) as grown_shard from placed"""


TOP_PRODUCTS = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as z from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(q.z) + 1), lambda i: q.z[i] * v.z[i])) as bigint) as score
            from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id and len(v.z) = len(q.z))
        select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10"""

LINKED_COMPONENTS = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        sets as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
        each as (select doc_id, unnest(s) as g, len(s) as n from sets),
        shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from each a join each b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from shared where 100 * common >= 85 * (na + nb - common) union all select b, a from shared where 100 * common >= 85 * (na + nb - common)),
        reach as (select distinct a, a as b from links union select r.a, l.b from reach r join links l on r.b = l.a),
        least as (select a, min(b) as component_id from reach group by a)
        select doc_id, len(s) as n_shingles, coalesce(component_id, doc_id) as component_id from sets left join least on doc_id = a"""
