"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

Leaves of one group (a null group is one too) stand in the order of a column; every ``fanout`` consecutive nodes become the hash of their
concatenation, the last run of a level as it is, until one node is left: the group's subroot. Subroots, in the order of their groups, become
the root in the same way. Digests are lowercase hex text throughout.

A block is an aligned stretch of ``fanout ** levels`` nodes, so its top is one node of the whole tree. It keeps each of its levels as one
string of concatenated digests: parents are hashes of its substrings of fixed width, and the siblings of a node are the substrings on either
side of it in its run. The tops of all blocks are the leaves of a smaller tree, built in the same way, until each group has one node. Proofs come
back down from there: a block's rows append what their block's top has to prove. No task sees more than one block at a time, and a level's
table is smaller than the one below it by the size of a block; a large group is only more blocks.

Cases: null groups come first and group keys are compared as UTF-8 bytes; leaves of equal order (null before all) go by their hash, and
equal leaves in any order, which gives the same tree; repeated rows are leaves each; a lone leaf is its subroot, and a lone subroot the root; an
empty table gives no rows; null fields hash as ``-``; texts are hashed whole; columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import stage
from labelmill.operators.ids import spread_order

#: Hex digits of a digest.
WIDTH = 64
FANOUT = 2
#: Levels of a block: with two children a node, 256 leaves, whose levels take 32 kB.
LEVELS = 8

_POSITION_MASK = (1 << 33) - 1


def leaf_text(fields: Sequence[Column]) -> Column:
    """What a leaf hashes: each value as byte count, colon, text; null as a hyphen."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[part(f) for f in fields])


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(leaf_text(fields), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, siblings: F.sha2(F.concat(siblings["left"], node, siblings["right"]), 256))


def _bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)``, with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), build), 0)


def _cut(level: Column, node: Column, nodes: Column) -> Column:
    """The digests of ``nodes`` consecutive nodes of a level, from number ``node`` on. Levels are binary: a substring is found at once."""
    return F.substring(level, node * WIDTH + 1, nodes * WIDTH)


def _size(level: Column) -> Column:
    return F.floor(F.octet_length(level) / WIDTH).cast("int")


def _parents(level: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(_size(level) / fanout).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: F.sha2(_cut(level, r * fanout, F.lit(fanout)), 256)), "").cast("binary")


def _height(nodes: Column, fanout: int, levels: int) -> Column:
    """Levels above the lowest that a block has, in a group of so many nodes: those that end in one node, but at most ``levels``."""
    out = F.lit(levels)
    for k in range(levels - 1, -1, -1):
        out = F.when(nodes <= fanout**k, k).otherwise(out)
    return out


def _levels(lowest: Column, height: Column, fanout: int, levels: int) -> Column:
    """All levels of a block, from the lowest up, each one string."""
    steps = F.slice(F.array(*[F.lit(k) for k in range(levels)]), F.lit(1), height)
    return F.aggregate(steps, F.array(lowest), lambda done, _: F.concat(done, F.array(_bound(F.element_at(done, -1), lambda level: _parents(level, fanout)))))


def _siblings(levels: Column, place: Column, fanout: int) -> Column:
    """Level by level, the digests left and right of a node in its run; ``place`` is that of the leaf in the block."""
    def at(level: Column, k: Column) -> Column:
        def segments(node: Column) -> Column:
            first = node - node % fanout
            after = F.least(first + F.lit(fanout), _size(level)) - node - 1
            return F.struct(_cut(level, first, node - first).cast("string").alias("left"), _cut(level, node + 1, after).cast("string").alias("right"))

        return _bound(F.floor(place / F.pow(F.lit(fanout), k)).cast("int"), segments)

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def _placed(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``g, pos, n, node, payload``: each node's place in its group and the group's size, and the size of the largest group. No task sees a
    whole group: the rows are range sorted and written with their task and their place in it, as facts that no retry changes, and a
    group's offsets are sums over the counts of the tasks that hold some of it."""
    ordered = spread_order(nodes, ["g", *order]).select("g", "node", "payload")
    written = stage(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias("at")), "leaves")
    group = Window.partitionBy("g")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    offsets = stage(parts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total")), "offsets")
    placed = written.join(offsets, ["g", "part"]).select("g", (F.col("at") + F.col("shift")).alias("pos"), F.col("total").alias("n"), "node", "payload")
    return placed, offsets.agg(F.max("total")).first()[0] or 0


def _blocks(nodes: DataFrame, fanout: int, levels: int, *carried: str) -> DataFrame:
    """``g, block, of, held``: the nodes of each block in order, and how many its group has."""
    held = F.array_sort(F.collect_list(F.struct("pos", "node", *carried)))
    return nodes.groupBy("g", F.floor(F.col("pos") / fanout**levels).alias("block")).agg(F.max("n").alias("of"), held.alias("held"))


def _strings(fanout: int, levels: int) -> Column:
    """The levels of a block of ``_blocks``."""
    lowest = F.array_join(F.transform("held", lambda x: x["node"]), "").cast("binary")
    return _bound(lowest, lambda level: _levels(level, _height(F.col("of"), fanout, levels), fanout, levels))


def _climb(nodes: DataFrame, largest: int, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes, the tops of their blocks, the tops of those tops' blocks, up to one node for each group."""
    tables, size = [nodes], fanout**levels
    while largest > 1:
        top = F.element_at(_strings(fanout, levels), -1).cast("string")
        tops = _blocks(tables[-1], fanout, levels).select("g", F.col("block").alias("pos"), F.ceil(F.col("of") / size).alias("n"), top.alias("node"), F.lit(0).alias("payload"))
        tables.append(stage(tops, "block_tops"))
        largest = -(-largest // size)
    return tables


def _descend(tables: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``payload, proof, tops`` of the lowest table's nodes; ``above`` has ``g, pos, proof, tops`` of the highest table's."""
    if len(tables) == 1:
        return tables[0].join(above, ["g", "pos"]).select("payload", "proof", "tops")

    def proved(strings: Column) -> Column:
        return F.transform("held", lambda x, i: F.struct(x["pos"].alias("pos"), x["payload"].alias("payload"), F.concat(_siblings(strings, i, fanout), F.col("rest")).alias("proof")))

    for nodes in tables[-2::-1]:
        rest = above.select("g", F.col("pos").alias("block"), F.col("proof").alias("rest"), "tops")
        blocks = _blocks(nodes, fanout, levels, "payload").join(rest, ["g", "block"])
        above = blocks.select("g", "tops", F.inline(_bound(_strings(fanout, levels), proved)))
    return above.select("payload", "proof", "tops")


def manifest(rows: DataFrame, leaf: Column, group: str, order: str, keep: Sequence[str], *, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``leaf``, ``subroot``, ``root`` and ``proof`` of every row: level by level from the leaf to
    the root, the digests ``left`` and ``right`` of the node in its run, so that ``fold(leaf, proof)`` is the root."""
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be at least 2 and levels at least 1")
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    hashed = rows.select(key.alias("g"), leaf.alias("node"), F.col(f"`{order}`").alias("by"), kept.alias("kept"))
    # Texts are read once: sorting samples its input, so it must not compute the hashes.
    hashed = stage(hashed.select("g", "node", "by", F.struct("node", "kept").alias("payload")), "leaf_hashes")
    trees = _climb(*_placed(hashed, ["by", "node"]), fanout, levels)
    subroots = trees[-1].select(F.lit("").alias("g"), "node", F.col("g").alias("payload"))
    joint = _climb(*_placed(subroots, ["payload"]), fanout, levels)
    none = F.array().cast("array<struct<left: string, right: string>>")
    across = _descend(joint, joint[-1].select("g", "pos", none.alias("proof"), F.col("node").alias("tops")), fanout, levels)
    across = stage(across.select(F.col("payload").alias("g"), "proof", F.col("tops").alias("root")), "group_proofs")
    above = trees[-1].join(across, "g").select("g", "pos", "proof", F.struct(F.col("node").alias("subroot"), "root").alias("tops"))
    proved = _descend(trees, above, fanout, levels)
    return proved.select(F.col("payload.kept").alias("row"), F.col("payload.node").alias("leaf"), "tops.subroot", "tops.root", "proof")
