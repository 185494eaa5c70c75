"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

# CRC-32 of a list of bytes: the reflected polynomial, one bit at a time.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::ubigint, {0}),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda v, i: xor(v >> 1, 3988292384::ubigint * (v & 1)))), 4294967295::ubigint)"""
BYTES_SQL = """list_transform(regexp_extract_all(hex(encode({0})), '..'),
  lambda h: ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::ubigint)"""


def crc32(text: str) -> str:
    return CRC_SQL.format(BYTES_SQL.format(text))


def resampling(buckets: int, percent: int, least_words: int, seed: int) -> str:
    """Resampling over single words."""
    words = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"""
    return f"""
with own as (select doc_id, {words} as word from documents),
aim as (select {words} as word from benchmark),
vocabulary as (select word, {crc32('word')} % {buckets} as bucket
               from (select word from own union select word from aim)),
s as (select bucket, count(*) as n from own join vocabulary using (word) group by bucket),
t as (select bucket, count(*) as n from aim join vocabulary using (word) group by bucket),
gains as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {buckets})::double
      / ((s.n + 1)::double * ((select coalesce(sum(n), 0) from t) + {buckets})::double)))::bigint as gain
  from s left join t using (bucket)
),
weighted as (
  select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from own join vocabulary using (word) join gains using (bucket) group by doc_id
),
scored as (
  select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::bigint + 0.5)::double
           / 4294967296::double)))::bigint as score
  from documents d left join weighted using (doc_id)
),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= {least_words}
)
select scored.doc_id, n_features, weight, score,
       case when rank <= {percent} * (select count(*) from drawn) // 100 then rank end as rank
from scored left join drawn using (doc_id)"""


def _climb(name: str, group: str, levels: int) -> str:
    """Levels of a tree of threes: ``name0`` has (group, idx, h); a group that has one node left keeps it."""
    parts = []
    for k in range(levels):
        parts.append(f"""{name}{k + 1} as (
  select {group}, case when n = 1 then idx else idx // 3 end as idx,
         case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by idx)) end as h
  from (select *, count(*) over (partition by {group}) as n from {name}{k}) group by {group}, n, case when n = 1 then idx else idx // 3 end
)""")
        # Of every node its neighbours under the same parent, as text to the left and to the right.
        parts.append(f"""{name}_side{k} as (
  select {group}, idx,
         coalesce(string_agg(h, '' order by idx) over (run rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(h, '' order by idx) over (run rows between 1 following and unbounded following), '') as r,
         count(*) over (partition by {group}) > 1 as moves
  from {name}{k} window run as (partition by {group}, idx // 3 order by idx)
)""")
    return ",\n".join(parts)


def manifest(leaf_levels: int = 8, root_levels: int = 3) -> str:
    """Manifest of documents by source; sources have up to 3 ** leaf_levels rows, of up to 3 ** root_levels sources."""
    plain = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(plain, ('doc_id', 'source', 'lang', 'n_chars')))} || {plain(text)})"
    own = lambda k: f"leaves.idx // {3 ** k}"
    fold, joins, proof = "f0", [], []
    steps = [("leaf", k, "leaves.tree", own(k)) for k in range(leaf_levels)] + [("top", k, "''", f"leaves.place // {3 ** k}") for k in range(root_levels)]
    folds = []
    for i, (name, k, tree, place) in enumerate(steps):
        joins.append(f"join {name}_side{k} s{i} on s{i}.tree = {tree} and s{i}.idx = case when s{i}.moves then {place} else 0 end")
        proof.append(f"case when s{i}.moves then s{i}.l || s{i}.r else '' end")
        folds.append(f"m{i}, l{i}, r{i}")
    nested = "select *, folded as f0 from sides"
    for i in range(len(steps)):
        nested = f"select *, case when m{i} then sha256(l{i} || f{i} || r{i}) else f{i} end as f{i + 1} from ({nested})"
    sides = ", ".join(f"s{i}.moves as m{i}, s{i}.l as l{i}, s{i}.r as r{i}" for i in range(len(steps)))
    return f"""
with leaves as (
  select doc_id, coalesce('=' || source, '') as tree, {leaf('text')} as leaf,
         case when {crc32('doc_id::varchar')} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf('text')} end as folded,
         row_number() over (partition by source order by doc_id) - 1 as idx
  from documents
),
leaf0 as (select tree, idx, leaf as h from leaves),
{_climb('leaf', 'tree', leaf_levels)},
top0 as (select '' as tree, row_number() over (order by tree) - 1 as idx, h, tree as source_tree from leaf{leaf_levels}),
{_climb('top', 'tree', root_levels)},
sides as (
  select doc_id, leaf, folded, b.h as subroot, (select h from top{root_levels}) as root,
         sha256({' || '.join(proof)}) as proof_sha256, {sides}
  from (select leaves.*, top0.idx as place from leaves join top0 on top0.source_tree = leaves.tree) leaves
  join leaf{leaf_levels} b on b.tree = leaves.tree
  {' '.join(joins)}
)
select doc_id, leaf, subroot, root, proof_sha256, {fold[0]}{len(steps)} as folded_root, {fold[0]}{len(steps)} = root as verified
from ({nested})"""
