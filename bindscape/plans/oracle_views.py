"""DuckDB text of the domain views, for the independent SQL oracle.

Only the raw driver tables are registered in the oracle's DuckDB, so every
oracle query inlines the views it needs as CTEs (``with_views``).
"""

from __future__ import annotations

import re

# DuckDB 2 spells lambdas ``lambda x: ...``; the oracle text is written with arrows.
_LAMBDA = re.compile(r"\b([a-z_][a-z0-9_]*)\s*->\s*")

VIEWS = {
    "t_proteins": """
select doc_id as protein_id, case when doc_id%7=0 then lower(q) else q end as protein from (
 select doc_id, case when doc_id%5=0 then l else translate(l,'BJOUXZ','') end as q from (
  select doc_id, upper(regexp_replace(text,'[^A-Za-z]','','g')) as l from documents) a) b""",
    "t_compounds": """
select p_partkey as compound_id,
 (['CCO','CC(=O)O','c1ccccc1','CCN(CC)CC','CC(C)O','CCOCC','CC(C)(C)O','c1ccc(cc1)O','CC(=O)N','CCCCCCCCCCCCCCCCCC(=O)O'])[(p_partkey%10)+1]
 || repeat('C', cast(p_size%4 as int)) || repeat('N', cast(p_partkey%3 as int))
 || case when p_partkey%11=0 then 'Cl' when p_partkey%11=1 then 'Br' else '' end
 || case when p_partkey%13=0 then '(' else '' end as compound
from part""",
    "t_descriptors": """
select p_partkey as compound_id, p_retailprice as molecular_weight, p_size/8.0::double as alogp,
       p_size%8 as hbd, p_size%14 as hba, cast(p_partkey%5 as int) as max_phase from part""",
    "t_interactions_ids": """
select l_orderkey, l_linenumber, l_partkey as compound_id, l_suppkey as protein_id,
 case when l_linenumber%3=0 then l_extendedprice else l_quantity/5.0::double end as affinity,
 case l_returnflag when 'R' then 'davis' when 'A' then 'kiba' else 'bindingdb' end as source_dataset,
 case l_linestatus when 'O' then 'train' else 'test' end as source_split
from lineitem""",
    "t_interactions": """
select i.*, c.compound, p.protein from t_interactions_ids i
 join t_compounds c on c.compound_id = i.compound_id
 join t_proteins p on p.protein_id = i.protein_id""",
    "t_scored": """
select doc_id, quality as y_true, round(0.6::double*u+0.4::double*quality*u, 2) as score from (
 select doc_id, quality,
  cast(cast('0x'||substr(md5(cast(doc_id as varchar)),1,8) as bigint) as double)/4294967296::double as u
 from labels) a""",
    "t_requests": """
select event_id, ts, cast(user_id as varchar)||'|'||event_type as cache_key,
       value as latency_ms, cast(event_id%3 as int) as priority
from events""",
    "t_emb": """
select vec_id, cast(embedding as double[]) as embedding, label from embeddings""",
    "t_users": """
select c_custkey as id, c_name as username, c_acctbal>0 as is_active,
 case c_custkey%4 when 0 then 'admin' when 1 then 'researcher' when 2 then 'viewer' else 'guest' end as role
from customer""",
    "t_workspaces": """
select conv_id as id, concat('conv ',conv_id) as name, max(case when turn=0 then text end) as description,
 conv_id%3=0 as is_public,
 list({'turn':turn, 'user_id':(conv_id*10+turn)%97, 'role':role} order by turn) as members
from conversations group by conv_id""",
}

DEPENDS = {
    "t_interactions": ["t_interactions_ids", "t_compounds", "t_proteins"],
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of ``names`` (and what they depend on)."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    body = _LAMBDA.sub(lambda m: f"lambda {m.group(1)}: ", body)
    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
