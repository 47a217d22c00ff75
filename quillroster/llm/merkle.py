"""Merkle manifest of a dataset: a hash tree for each group of rows, and a proof for each row.

Bottom-up build: a row's leaf is the hash of its fields; leaves stand in their group by id, and each
level pairs the neighbours of the one below until a group has one node, its subroot. The subroots, in
the order of their groups, are the leaves of one more tree, whose last node is the root. Each level is
a table of its own in the shared folder. Top-down proof push: from the root down, each level's table
is joined with its parents, and each child puts its sibling before the proof that its parent has
inherited. Nothing but DataFrame functions; no group is ever gathered: leaves get their places by
ranges of (group, id), and what is grouped or joined is a node with its two children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import materialise
from quillroster.operators.ranking import ranked

#: The one group of the tree over the subroots.
TOP = ""
#: Nodes of a level, at most, that one task pairs or gives proofs to: small levels need no shuffle.
ONE_TASK = 32768
#: What a step of a proof begins with: the sibling's side. A step without a sibling is empty.
LEFT, RIGHT = b"\x00", b"\x01"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(fields: list[Column]) -> Column:
    """The hash of a row: each field as its UTF-8 length, a colon and its text, `-` where it is null."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


@dataclass
class Tree:
    """levels: _g, _i (place from 0), _n (nodes of the group at this level), _h and, above the lowest, the children's _left and _right (null: none); most: as many rows at most."""

    levels: list[DataFrame]
    most: list[int]

    def tops(self) -> DataFrame:
        """(_g, _h): the last node of each group."""
        out = self.levels[0].where("_n = 1").select("_g", "_h")
        for level in self.levels[1:]:
            out = out.unionByName(level.where("_n = 1").select("_g", "_h"))
        return out


@dataclass
class Manifest:
    leaves: DataFrame
    groups: Tree
    top: Tree
    root: str | None


def _narrow(df: DataFrame, most: int) -> DataFrame:
    """df in one partition if it has few enough rows."""
    return df.coalesce(1) if most <= ONE_TASK else df


def build_tree(nodes: DataFrame, label: str) -> Tree:
    """nodes: _g, _i, _n, _h, read as often as there are levels."""
    rows, longest = nodes.agg(F.count("*"), F.coalesce(F.max("_n"), F.lit(1))).first()
    levels, most = [nodes], [rows]
    while longest > 1:
        side = lambda odd: F.max(F.when(F.col("_i") % 2 == odd, F.col("_h")))
        pairs = _narrow(levels[-1], most[-1]).where("_n > 1").groupBy("_g", F.expr("_i div 2").alias("_i"), F.expr("(_n + 1) div 2").alias("_n")).agg(side(0).alias("_left"), side(1).alias("_right"))
        levels.append(materialise(pairs.withColumn("_h", digest(F.concat("_left", F.coalesce("_right", F.lit(""))))), f"{label}{len(levels)}"))
        longest, most = (longest + 1) // 2, [*most, -(-2 * most[-1] // 3)]  # three nodes become two, more become fewer
    return Tree(levels, most)


def build_manifest(df: DataFrame, fields: list[Column], id_col: str = "doc_id", group_col: str = "lang", more: dict[str, Column] | None = None) -> Manifest:
    """The tree of df's rows, each leaf the hash of its fields; more: columns to be kept beside the leaves.

    Leaves ascend by id within a group (null ids first; rows that repeat an id by their leaf, so that the
    root does not depend on how df is dealt). Null is a group of its own, before all others, which
    follow in the order of their UTF-8 bytes. An empty table has no leaves and no root. Columns of df
    other than those named, whatever their names, take no part.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(TOP))
    kept = {f"_kept_{name}": made for name, made in (more or {}).items()}
    rows = df.select(group.alias("_g"), F.col(id_col).alias("_id"), leaf_of(fields).alias("_h"), *[made.alias(name) for name, made in kept.items()])
    hashed = materialise(rows, "hashes")  # ranges are sampled first: texts are read once all the same
    leaves = materialise(ranked(hashed, "_g", [F.col("_id").asc_nulls_first(), F.col("_h")], "leaves").select("_g", "_id", F.col("_pos").alias("_i"), F.col("_total").alias("_n"), "_h", *kept), "leaves")
    groups = build_tree(leaves.select("_g", "_i", "_n", "_h"), "nodes")
    tops = ranked(groups.tops(), None, [F.col("_g")], "subroots").select(F.lit(TOP).alias("_g"), F.col("_pos").alias("_i"), F.col("_total").alias("_n"), "_h", F.col("_g").alias("_of"))
    top = build_tree(materialise(tops, "subroots"), "tops")
    root = top.tops().first()  # one row at most
    return Manifest(leaves, groups, top, root and root["_h"])


def _push(tree: Tree, inherited: DataFrame, groups: int) -> DataFrame:
    """inherited (_g, _sub, _suffix): what the last node of each of so many groups hands down -> _g, _i, _sub, _proof for each node of the lowest level."""
    step = lambda side, sibling: F.when(F.col(sibling).isNull(), F.lit(b"")).otherwise(F.concat(F.lit(side), F.unhex(sibling)))
    parents = None
    for k in range(len(tree.levels) - 1, -1, -1):
        most = max(tree.most[k], groups)
        level, tops = _narrow(tree.levels[k], most), _narrow(inherited, most)
        children = [] if k == 0 else ["_left", "_right"]
        here = level.where("_n = 1").join(tops, "_g").select("_g", "_i", *children, "_sub", F.col("_suffix").alias("_proof"))
        if parents is not None:
            below = level.where("_n > 1").select("_g", "_i", *children, F.expr("_i div 2").alias("_up"))
            above = parents.select("_g", F.col("_i").alias("_up"), F.col("_left").alias("_pl"), F.col("_right").alias("_pr"), "_sub", "_proof")
            sibling = F.when(F.col("_i") % 2 == 0, step(RIGHT, "_pr")).otherwise(step(LEFT, "_pl"))
            here = here.unionByName(below.join(above, ["_g", "_up"]).select("_g", "_i", *children, "_sub", F.concat(F.array(sibling), F.col("_proof")).alias("_proof")))
        if k == 0:
            return here
        parents = _narrow(materialise(here, f"proofs{k}"), max(tree.most[k - 1], groups))
    raise AssertionError("a tree has a level")


def prove(manifest: Manifest) -> DataFrame:
    """One row for each leaf: _id, _leaf, _subroot, _root, _proof (see fold), and what was kept beside it under its name."""
    nothing = F.array().cast("array<binary>")
    start = manifest.top.tops().select("_g", F.lit(None).cast("string").alias("_sub"), nothing.alias("_suffix"))
    top = _push(manifest.top, start, 1).select("_i", "_proof")
    inherited = materialise(manifest.top.levels[0].join(top, "_i").select(F.col("_of").alias("_g"), F.col("_h").alias("_sub"), F.col("_proof").alias("_suffix")), "inherited")
    proofs = _push(manifest.groups, inherited, manifest.top.most[0])
    kept = [F.col(c).alias(c.removeprefix("_kept_")) for c in manifest.leaves.columns if c.startswith("_kept_")]
    rows = manifest.leaves.join(proofs, ["_g", "_i"])
    return rows.select("_id", F.col("_h").alias("_leaf"), F.col("_sub").alias("_subroot"), F.lit(manifest.root).alias("_root"), "_proof", *kept)


def _hash_in(step: Column) -> Column:
    return F.lower(F.hex(F.substring(step, 2, 32)))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to: proof has a step for each level, the sibling's side and hash, or nothing."""
    pair = lambda node, step: F.when(F.length(step) == 0, node).when(F.substring(step, 1, 1) == F.lit(LEFT), F.concat(_hash_in(step), node)).otherwise(F.concat(node, _hash_in(step)))
    return F.aggregate(proof, leaf, lambda node, step: digest(pair(node, step)))


def proof_digest(proof: Column) -> Column:
    """The hash of a proof's siblings, from the leaf to the root."""
    return digest(F.array_join(F.transform(proof, lambda step: F.when(F.length(step) == 0, F.lit("")).otherwise(_hash_in(step))), ""))


#: What a leaf of `documents` is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(df: DataFrame, tampered: Column) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Trees by lang. Where tampered holds, folded_root starts from the leaf of a row whose n_chars is one
    more (a null stays null, so that such a row still verifies); null counts as not tampered. Null ids,
    rows that repeat an id, empty tables and clashing columns: see build_manifest.
    """
    more = F.when(tampered, F.expr("cast(n_chars AS decimal(20, 0)) + 1")).otherwise(F.col("n_chars").cast("decimal(20, 0)"))
    changed = leaf_of([more if f == "n_chars" else F.col(f) for f in FIELDS])
    proved = prove(build_manifest(df, [F.col(f) for f in FIELDS], more={"changed": changed}))
    rows = proved.withColumn("folded_root", fold(F.col("changed"), F.col("_proof")))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_leaf").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), proof_digest(F.col("_proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("_root")).alias("verified"))
