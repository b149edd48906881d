"""Merkle manifest of a data set: a hash for each row, one for all, and a proof for each row.

Rows are leaves.  Those of a group, in order, are hashed upwards in runs of ``width`` nodes,
the last run being shorter, until one is left, the group's subroot; the subroots, in order of
the groups, are hashed the same way into the root.  A node is the sha256 of its run's nodes,
as lower-case hex text, end to end.

Nodes lie in aligned blocks, so a block's levels need no other block.  Each level of a block is
one string of hex digests: parents are hashes of its fixed-width substrings, and what flanks a
node inside its run, left and right, is the node's segment of the proof, again two substrings.
The blocks' top nodes are the nodes of the next round, until a group is one block; rounds shrink
by the block's size.  On the way back every block passes its own path, from its node to the
root, to its members; blocks are joined one to one, so no group, however large, meets in a task.

Places of the leaves come from one range partition: a row's place in its task, plus the rows of
its group in the tasks before.  Texts are hashed where they are read and never shuffled.

Cases: a null field is written ``-`` and a null group comes first; null ids come first in their
group; rows equal in the order are ordered by their leaf, and rows equal in that too have equal
hashes, each with its own place; a text of any length is one leaf; a lone leaf is its group's
subroot, a lone subroot the root; a proof without siblings is the hash of nothing; an empty
table has no rows; further columns are not read, so none clashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Nodes of a run, up to 36, and at most so many of a block.
WIDTH = 2
BLOCK_NODES = 256
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a task's rows in the numbers that Spark gives.
_ROW_BITS = 33


def field(value: Column) -> Column:
    """A value as it goes into a hash: its bytes' number, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Tree(NamedTuple):
    """Blocks of every round, the first with the leaves, and each group's top node."""

    rounds: list[DataFrame]
    tops: DataFrame
    width: int


def per_round(width: int) -> int:
    """Levels that a block of at most ``BLOCK_NODES`` nodes has."""
    levels = 1
    while width ** (levels + 1) <= BLOCK_NODES:
        levels += 1
    return levels


def placed(nodes: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    """Nodes with their place in their group and the levels above them.

    ``nodes`` has a string ``grp``, never null, a ``node`` and what else its rows carry.
    """
    salted = nodes.withColumn("_salt", F.rand(0))
    ranged = salted.repartitionByRange("grp", *order, "node", "_salt").sortWithinPartitions("grp", *order, "node")
    rows = materialize(ranged.drop("_salt").withColumn("_row", F.monotonically_increasing_id()), "leaves")
    task, here = F.shiftright("_row", _ROW_BITS).alias("_task"), F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    # A row for each group and task.
    sizes = rows.groupBy("grp", task).agg(F.count("*").alias("_n"), F.min(here).alias("_first"))
    group = Window.partitionBy("grp")
    before = F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        "grp",
        "_task",
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_before"),
        F.sum("_n").over(group).alias("_size"),
    )
    last = F.conv((F.col("_size") - 1).cast("string"), 10, width)
    return (
        rows.select("*", task, here.alias("_here"))
        .join(materialize(offsets, "offsets"), ["grp", "_task"])
        .withColumn("pos", F.col("_before") + F.col("_here"))
        .withColumn("above", F.when(F.col("_size") > 1, F.length(last)).otherwise(0))
        .drop("_row", "_task", "_here", "_before", "_size")
    )


def blocks_of(nodes: DataFrame, width: int) -> DataFrame:
    """A round: ``grp, block, above, depth, members, l0 ... , top`` of every aligned block."""
    levels = per_round(width)
    size, run = width**levels, HEX * width
    rest = [c for c in nodes.columns if c not in ("grp", "above")]
    member = F.struct("pos", *[c for c in rest if c != "pos"])
    blocks = nodes.groupBy("grp", F.floor(F.col("pos") / F.lit(size)).alias("block")).agg(
        F.first("above").alias("above"), F.array_sort(F.collect_list(member)).alias("members")
    )
    blocks = blocks.withColumn("depth", F.least("above", F.lit(levels)))
    blocks = blocks.withColumn("l0", F.expr("array_join(transform(members, m -> m.node), '')"))
    for k in range(1, levels + 1):
        below = f"l{k - 1}"
        hashed = (
            f"array_join(transform(sequence(0, int((length({below}) - 1) div {run})),"
            f" i -> sha2(substring({below}, i * {run} + 1, {run}), 256)), '')"
        )
        blocks = blocks.withColumn(f"l{k}", F.expr(f"if(depth >= {k}, {hashed}, null)"))
    tops = F.coalesce(*[F.col(f"l{k}") for k in range(levels, -1, -1)])
    return materialize(blocks.withColumn("top", tops), "blocks")


def build(nodes: DataFrame, order: Sequence[str], width: int = WIDTH) -> Tree:
    """The trees of all groups, one round of blocks after the other."""
    if not 2 <= width <= 36:
        raise ValueError("a run has 2 to 36 nodes")
    levels, rounds = per_round(width), []
    nodes = placed(nodes, order, width)
    while True:
        rounds.append(blocks_of(nodes, width))
        further = F.col("above") > levels
        # As many rounds as the largest group needs.
        if not (rounds[-1].agg(F.max("above")).first()[0] or 0) > levels:
            break
        nodes = rounds[-1].where(further).select(
            "grp", F.col("block").alias("pos"), F.col("top").alias("node"), (F.col("above") - levels).alias("above")
        )
    done = [r.where(F.col("above") <= levels).select("grp", F.col("top").alias("node")) for r in rounds]
    tops = done[0]
    for more in done[1:]:
        tops = tops.unionByName(more)
    return Tree(rounds, materialize(tops, "tops"), width)


def segment(width: int) -> str:
    """SQL for what flanks node ``m`` at each level of its block."""
    steps = []
    for k in range(per_round(width)):
        at = f"int(m.pos % {width ** per_round(width)} div {width**k})"
        start = f"({at} - {at} % {width})"
        left = f"substring(l{k}, {start} * {HEX} + 1, ({at} - {start}) * {HEX})"
        right = f"substring(l{k}, ({at} + 1) * {HEX} + 1, ({start} + {width - 1} - {at}) * {HEX})"
        steps.append(f"named_struct('l', {left}, 'r', {right})")
    return f"slice(array({', '.join(steps)}), 1, depth)"


def paths(tree: Tree, above_tops: DataFrame) -> DataFrame:
    """Every leaf's row with ``path``, its siblings level by level to the root.

    ``above_tops`` has ``grp``, its top node's ``path`` further up, and what else the leaves are to know.
    """
    extra = [c for c in above_tops.columns if c not in ("grp", "path")]
    levels, coming = per_round(tree.width), None
    for i in range(len(tree.rounds) - 1, -1, -1):
        blocks = tree.rounds[i]
        arrived = blocks.where(F.col("above") <= levels).join(above_tops, "grp")
        if coming is not None:
            inner = blocks.where(F.col("above") > levels).join(coming, ["grp", "block"])
            arrived = arrived.unionByName(inner)
        members = F.expr(
            f"transform(members, m -> named_struct('m', m, 'path', concat({segment(tree.width)}, path)))"
        )
        leaves = arrived.select("grp", *extra, F.explode(members).alias("x"))
        if i:
            coming = materialize(
                leaves.select("grp", *extra, F.col("x.m.pos").alias("block"), F.col("x.path").alias("path")), "paths"
            )
    return leaves.select("grp", *extra, "x.m.*", "x.path")


def proof_hash(path: Column) -> Column:
    """The siblings of a path, hashed as one."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]), 256))


def manifest(leaves: DataFrame, order: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Rows of ``leaves`` (``grp``, ``node``, further columns) with ``path``, ``subroot`` and ``root``."""
    tree = build(leaves, order, width)
    subroots = tree.tops.select(F.lit("").alias("grp"), "node", F.col("grp").alias("of"))
    upper = build(subroots, ["of"], width)
    root = upper.tops.select("grp", F.col("node").alias("root"), F.expr("cast(array() as array<struct<l:string,r:string>>)").alias("path"))
    groups = paths(upper, root).select(F.col("of").alias("grp"), F.col("node").alias("subroot"), "root", "path")
    return paths(tree, materialize(groups, "subroots"))


def tampered(id_col: Column) -> Column:
    """Rows that the check of proofs changes: the ids whose crc32 seven divides; a null id is none."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents``, and the leaf of the row with ``n_chars`` changed where it is tampered with."""
    values = [F.col(c) for c in FIELDS]
    # One more digit than a long has.
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = row_hash([more if c == "n_chars" else F.col(c) for c in FIELDS])
    return docs.select(
        # A text for every group, in the groups' order.
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        row_hash(values).alias("node"),
        F.when(tampered(F.col("doc_id")), changed).alias("changed"),
    )


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: its leaf, its group's subroot, the root, its proof's digest, and what folding gives."""
    rows = manifest(document_leaves(docs), ["doc_id"], width)
    found = folded(F.coalesce("changed", "node"), F.col("path"))
    return rows.select(
        "doc_id",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        proof_hash(F.col("path")).alias("proof_sha256"),
        found.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
