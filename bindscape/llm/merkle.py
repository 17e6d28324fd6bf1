"""Merkle manifest of a dataset by cogrouped subtree exchange.

Each row is a leaf, the digest of its fields. The leaves of a group (a source) are ordered by id and
numbered exactly; runs of three consecutive nodes are hashed into their parent until one node is left,
the group's root. The roots of the groups, ordered by group, make the tree of the dataset.

The work is cut into superblocks of 3 ** DEPTH consecutive nodes of one tree. Upwards, each superblock
reduces its nodes to one; the reduced nodes are the nodes of the next, smaller table, until every tree is
one node. Downwards, the nodes of a superblock are cogrouped with the row of outer siblings that the
larger tree holds for it; one function repeats the local reduction, joins local and outer siblings to the
proof of each node, and folds a claimed leaf along it. A task sees one superblock and one path, whatever
the size of a source.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.operators.ranking import partition_rank
from bindscape.session import cut_lineage

ARITY = 3
DEPTH = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Lower-case hex SHA-256 over the fields: ``-`` for null, else ``<UTF-8 bytes>:<value>``."""
    strings = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(s.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in strings]), 256)


def block_levels(nodes: list[str], alone: bool, depth: int) -> list[list[str]]:
    """The nodes of a superblock level by level: up to its one node. The only superblock of a tree
    (``alone``) ends as soon as one node is left; others go up all ``depth`` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 or (not alone and len(levels) <= depth):
        last = levels[-1]
        levels.append([digest("".join(last[i:i + ARITY])) for i in range(0, len(last), ARITY)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Per level below the top: what stands left and right of node ``at`` in its run."""
    out = []
    for level in levels[:-1]:
        first = at - at % ARITY
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + ARITY])))
        at //= ARITY
    return out


def pack(path: list[tuple[str, str]]) -> str:
    return "".join(f"{a},{b};" for a, b in path)


def unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")[:-1]]


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {ARITY ** depth}"))


def _reduce(nodes: DataFrame, depth: int) -> DataFrame:
    """``(tree, idx, node)`` -> the one node of each superblock, numbered by superblock."""

    def up(key, rows):
        import pandas as pd
        levels = block_levels(rows.sort_values("idx")["node"].tolist(), key[1] == 0, depth)
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "node": levels[-1]})

    return _blocks(nodes, depth).groupBy("tree", "block").applyInPandas(up, "tree string, idx long, node string")


def _exchange(nodes: DataFrame, outer: DataFrame, depth: int, schema: str, finish) -> DataFrame:
    """Cogroup nodes and outer rows ``(tree, idx, path, subroot, root)`` by superblock; ``finish(node row,
    path, outer row)`` gives the result row of each node."""
    names = [x.split()[0] for x in schema.split(", ")]

    def down(key, rows, outside):
        import pandas as pd
        rows = rows.sort_values("idx")
        levels = block_levels(rows["node"].tolist(), key[1] == 0, depth)
        above = outside.iloc[0]
        beyond = unpack(above["path"])
        found = [finish(r, siblings(levels, i) + beyond, above) for i, r in enumerate(rows.itertuples(index=False))]
        return pd.DataFrame(found, columns=names)

    above = outer.withColumnRenamed("idx", "block")
    return (_blocks(nodes, depth).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
            .applyInPandas(down, schema))


def _stages(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The node tables of the superblock stages, from the leaves to one node per tree."""
    stages = [nodes]
    while (stages[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        stages.append(cut_lineage(_reduce(stages[-1].select("tree", "idx", "node"), depth)))
    return stages


OUTER = "tree string, idx long, path string, subroot string, root string"


def _paths(stages: list[DataFrame], outer: DataFrame, depth: int) -> DataFrame:
    """Outer rows of the superblocks of the leaves, from those of the trees' roots down."""
    for nodes in reversed(stages[1:]):
        outer = cut_lineage(_exchange(nodes, outer, depth, OUTER, lambda r, path, above: (
            r.tree, r.idx, pack(path), above["subroot"], above["root"])))
    return outer


RESULT = ("id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def audit(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Proofs of the leaves ``(tree, id, leaf, claim, at)``, ordered within a tree by ``at`` (nulls first,
    ties by leaf and claim): ``RESULT`` with the fold of each ``claim`` along the proof of its leaf."""
    # digests are written before they are ordered, so that the texts are read once
    ranked = partition_rank(cut_lineage(rows), ["tree"], "at", ["leaf", "claim"], rank_col="rn")
    leaves = cut_lineage(ranked.select("tree", "id", F.col("leaf").alias("node"), "claim",
                                       (F.col("rn") - 1).alias("idx")))
    inner = _stages(leaves, depth)
    roots = inner[-1].select(F.lit(TOP).alias("tree"), F.col("tree").alias("at"), "node")
    tops = _stages(cut_lineage(partition_rank(roots, ["tree"], "at", rank_col="rn").select(
        "tree", F.col("at").alias("name"), "node", (F.col("rn") - 1).alias("idx"))), depth)
    crown = tops[-1].select("tree", "idx", F.lit("").alias("path"), F.lit("").alias("subroot"),
                            F.col("node").alias("root"))
    # the path of each group's root in the tree of the groups
    heads = _exchange(tops[0], _paths(tops, crown, depth), depth, OUTER, lambda r, path, above: (
        r.name, 0, pack(path), r.node, above["root"]))

    def finish(r, path, above):
        folded = fold(r.claim, path)
        return (r.id, r.node, above["subroot"], above["root"], digest("".join(a + b for a, b in path)), folded,
                folded == above["root"])

    return _exchange(leaves, _paths(inner, cut_lineage(heads), depth), depth, RESULT, finish)


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "source",
             claim: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: ``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``.

    ``leaf`` is the digest of the ``fields``, ``subroot`` the root of the row's group, ``root`` that of the
    dataset, ``proof_sha256`` the digest of the siblings on the way. ``claim`` is the leaf that somebody
    claims for the row (default: its own); ``folded_root`` is the root that the claim and the siblings
    give, ``verified`` whether it is the root. A superblock has 3 ** ``depth`` nodes.

    Null fields have a leaf of their own kind. A null group is a group and comes first. Rows with a null id
    come first in their group, repeated ids are ordered by leaf (equal rows are alike). A group of one row
    is its own root. An empty table gives an empty result. Other columns are ignored."""
    leaf = leaf_digest([F.col(f) for f in fields])
    group = F.col(group_col)
    rows = docs.select(
        # keeps the order of the groups by their bytes, null first
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group.cast("string"))).alias("tree"),
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("at"), leaf.alias("leaf"),
        (leaf if claim is None else claim).alias("claim"))
    out = audit(rows, depth)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def without_line_feeds(fields=FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row after the line feeds of its text are deleted where 2 divides the CRC-32 of the
    decimal id; the row's own leaf elsewhere."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
    return leaf_digest([text if f == text_col else F.col(f) for f in fields])
