"""Exact deduplication by deterministic block naming (DataFrame functions only).

Each text, its white space squeezed, is cut into fixed-size blocks of its UTF-8 bytes. The distinct
blocks are sorted and numbered: equal blocks get one integer name, different blocks different ones.
Then adjacent names are paired, the distinct pairs are sorted and numbered in turn, and so on until
one name is left for each document. Two documents have the same name at the same level exactly
when their texts are equal: no name rests on a hash alone.

Block texts are shuffled once, to be numbered, and equal blocks are merged before that shuffle.
After it, a 64-bit fingerprint stands for a block on its way back to its documents; a fingerprint
that belongs to several distinct blocks is found by counting and those blocks are joined by their
bytes instead. A group that holds a third of all rows is pre-aggregated in every grouping, and in
the joins both sides are exchanged, so that adaptive execution can split its partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillroster.llm.common import join_same, keep_one, materialise, squeezed, text_of

BLOCK_BYTES = 2048
#: What tells rows apart: the id, and for repeated ids the text's own hash and length.
ROW = ["_id", "_tag", "_len"]


def _numbered(df: DataFrame, keys: list[str], label: str, made: dict[str, Column] | None = None) -> DataFrame:
    """Distinct keys, sorted within hash partitions and numbered: (made or keys, _name)."""
    distinct = df.select(*keys).distinct().sortWithinPartitions(*keys)
    out = [c.alias(k) for k, c in made.items()] if made else [F.col(k) for k in keys]
    return materialise(distinct.select(*out, F.monotonically_increasing_id().alias("_name")), label)


def _block_list(block_bytes: int) -> Column:
    return F.expr(f"transform(sequence(0, _n - 1), i -> substring(_bytes, i * {block_bytes} + 1, {block_bytes}))")


def _named_blocks(rows: DataFrame, prepared: DataFrame, block_bytes: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """(row key, _n, _i, _name) for every block."""
    blocks = rows.select(F.explode(_block_list(block_bytes)).alias("_block"))
    numbered = _numbered(blocks, ["_block"], "blocks", {"_h": fingerprint(F.col("_block"))})
    by_print = materialise(numbered.groupBy("_h").agg(F.min("_name").alias("_name"), F.count("*").alias("_shared")), "names")
    marked = prepared.select(*ROW, "_n", F.posexplode("_prints").alias("_i", "_h")).join(by_print, "_h")
    out = marked.where("_shared = 1").select(*ROW, "_n", "_i", "_name")
    shared = by_print.where("_shared > 1").select("_h")
    if shared.isEmpty():
        return out
    # Fingerprints that several distinct blocks share: name those blocks by their bytes.
    clashing = rows.select(*ROW, "_n", F.posexplode(_block_list(block_bytes)).alias("_i", "_block")).withColumn("_h", fingerprint(F.col("_block"))).join(shared, "_h", "left_semi")
    exact = _numbered(clashing, ["_block"], "clashes").select("_block", (-1 - F.col("_name")).alias("_name"))
    return out.unionByName(clashing.join(exact, "_block").select(*ROW, "_n", "_i", "_name"))


def name_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each distinct (id, squeezed text): _id, _tag, _len, _sha, _m (rows that repeat it), _level, _name.

    (_level, _name) is the text's identity.
    """
    text = squeezed(text_of(text_col))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id", F.xxhash64("_text").alias("_tag"), F.octet_length("_text").alias("_len"), F.sha2("_text", 256).alias("_sha"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / block_bytes).cast("int")).alias("_n"), F.col("_text").cast("binary").alias("_bytes"),
    )
    listed = rows.select(*ROW, "_sha", "_n", F.transform(_block_list(block_bytes), lambda b: fingerprint(b)).alias("_prints"))
    prepared = materialise(listed.groupBy(*ROW).agg(F.first("_sha").alias("_sha"), F.count("*").alias("_m"), F.first("_n").alias("_n"), F.first("_prints").alias("_prints")), "prepared")

    level, now = 0, materialise(_named_blocks(rows, prepared, block_bytes, fingerprint), "level0")
    longest = now.agg(F.max("_n")).first()[0] or 1
    done = [now.where("_n = 1").select(*ROW, F.lit(0).alias("_level"), "_name")]
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = now.where("_n > 1").groupBy(*ROW, F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.expr("_i div 2").cast("int").alias("_i")).agg(F.max(F.expr("if(_i % 2 = 0, _name, null)")).alias("_a"), F.max(F.expr("if(_i % 2 = 1, _name, null)")).alias("_b"))
        pairs = materialise(pairs, f"pairs{level}")
        names = _numbered(pairs, ["_a", "_b"], f"names{level}")
        now = materialise(join_same(pairs, names, ["_a", "_b"]).select(*ROW, "_n", "_i", "_name"), f"level{level}")
        done.append(now.where("_n = 1").select(*ROW, F.lit(level).alias("_level"), "_name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return join_same(prepared.select(*ROW, "_sha", "_m"), identity, ROW)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal to each other. The smallest id of a group
    stays; null ids come after all others. Rows that repeat an id and its text each count towards
    group_size, and one of them is kept. An empty table gives an empty result. Other columns of df,
    whatever their names, are neither read nor returned.
    """
    named = materialise(name_documents(df, id_col, text_col, block_bytes, fingerprint), "named")
    groups = materialise(named.groupBy("_level", "_name").agg(F.min("_id").alias("keep_id"), F.sum("_m").alias("group_size")), "groups")
    one = F.explode(F.expr("sequence(1L, _m)"))
    return named.join(groups, ["_level", "_name"]).withColumn("_copy", one).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all columns kept: the smallest id's.

    Null ids and repeated rows are treated as in exact_dedup.
    """
    named = materialise(name_documents(df, id_col, text_col), "named")
    # The smallest (id, row key) of each group, nulls last.
    first = named.groupBy("_level", "_name").agg(F.min(F.struct(F.col("_id").isNull().alias("_no_id"), *ROW, "_m")).alias("_first"))
    stay = materialise(first.select(*[F.col(f"_first.{k}").alias(f"_k{k}") for k in ROW], F.col("_first._m").alias("_k_m")), "stay")
    text = squeezed(text_of(text_col))
    return keep_one(df, stay, {"_k_id": F.col(id_col), "_k_tag": F.xxhash64(text), "_k_len": F.octet_length(text)})
