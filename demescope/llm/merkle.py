"""Merkle manifest of a table: a digest tree per group, their roots in a tree of their own, a path for every row.

A tree is cut into aligned blocks of ``3 ** BLOCK_HEIGHT`` leaves. A block stores its nodes in van Emde Boas order:
the levels are split at half height, the top part comes first, then the parts below it one after another, each in
this order again. A node's address follows from its depth and place alone, so building a block and finding a
leaf's siblings are gathers. Block roots are the leaves of the next level of blocks, up to one block a tree.

Rows with equal keys are told apart by their digests; equal rows are leaves of their own. Null keys come first, a
null group is a group. An empty table has no rows in its manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from demescope.session import cut_lineage

ARITY = 3
BLOCK_HEIGHT = 6
BLOCK = ARITY**BLOCK_HEIGHT
DIGEST = 32


# --- addresses ----------------------------------------------------------------------------


def _size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(maxsize=None)
def _splits(levels: int, depth: int = 0) -> dict[int, tuple[int, int, int]]:
    """Per depth below the root: depth of the top part's root, nodes of the top part, nodes of one part below."""
    if levels == 1:
        return {}
    top = levels // 2
    here = {depth + top: (depth, _size(top), _size(levels - top))}
    return here | _splits(top, depth) | _splits(levels - top, depth + top)


def address(levels: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Where nodes of a tree of ``levels`` levels are stored, by depth and place from the left."""
    if depth == 0:
        return np.zeros_like(place)
    root, top, below = _splits(levels)[depth]
    fan = ARITY ** (depth - root)
    return address(levels, root, place // fan) + top + place % fan * below


# --- one block ----------------------------------------------------------------------------


def _height(leaves: int) -> int:
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def _counts(leaves: int, height: int) -> list[int]:
    """Nodes per level, leaves first."""
    counts = [leaves]
    for _ in range(height):
        counts.append(-(-counts[-1] // ARITY))
    return counts


def _build(leaves: np.ndarray, height: int) -> np.ndarray:
    """Nodes of a block in their stored order from its leaves' digests; places without a node are zero."""
    nodes = np.zeros((_size(height + 1), DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(len(level)))] = level
        if depth:
            text = level.tobytes().hex().encode()
            run = 2 * DIGEST * ARITY
            joined = b"".join(hashlib.sha256(text[a : a + run]).digest() for a in range(0, len(text), run))
            level = np.frombuffer(joined, np.uint8).reshape(-1, DIGEST)
    return nodes


_HEX = np.frombuffer(bytes(range(256)).hex().encode(), np.uint8).reshape(256, 2)


def _texts(nodes: np.ndarray, at: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Strings of ``counts`` digests each, as hex, of the nodes at ``at``."""
    offsets = np.concatenate([[0], np.cumsum(counts * 2 * DIGEST)]).astype(np.int32)
    data = _HEX[nodes[at]].tobytes()
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _siblings(nodes: np.ndarray, leaves: int, height: int) -> tuple[pa.Array, pa.Array]:
    """Per leaf and level, bottom first: the siblings before and those after, as two string arrays."""
    counts = _counts(leaves, height)
    place = np.arange(leaves)
    befores, afters, firsts = [], [], []
    for level in range(height):
        before = place % ARITY
        befores.append(before)
        afters.append(np.minimum(ARITY - before, counts[level] - place) - 1)
        firsts.append(place - before)
        place = place // ARITY
    before, after, first = (np.stack(x, axis=1).ravel() for x in (befores, afters, firsts))
    depth = np.tile(height - np.arange(height), leaves)
    out = []
    for n, start in ((before, first), (after, first + before + 1)):
        line = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        place, deep = start[line] + step, depth[line]
        at = np.zeros(len(line), np.int64)
        for d in range(1, height + 1):
            pick = deep == d
            at[pick] = address(height + 1, d, place[pick])
        out.append(_texts(nodes, at, n))
    return out[0], out[1]


# --- levels of blocks ---------------------------------------------------------------------


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``tree, slot, n, digest, key``: the place of each row in its tree and the tree's size.

    Rows are range partitioned, sorted inside a partition and written; places are offset by the sizes of the same
    tree's parts before. Equal rows are spread by the partition they come from, so no one range holds all of them.
    """
    keys = ["tree", *order, "digest"]
    spread = rows.withColumn("_from", F.spark_partition_id())
    placed = cut_lineage(
        spread.repartitionByRange(*keys, "_from")
        .sortWithinPartitions(*keys)
        .select("tree", "digest", "key", F.monotonically_increasing_id().alias("_at"))
    )
    part = F.shiftright("_at", 33).alias("_part")
    sizes = placed.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(tree).alias("n")
    )
    return placed.withColumn("_part", part).join(offsets, ["tree", "_part"]).select(
        "tree", (F.col("_offset") + F.col("_at") - F.col("_first")).alias("slot"), "n", "digest", "key"
    )


def _block_table(leaves: DataFrame) -> DataFrame:
    """``tree, block, n, members, nodes``: one row per aligned block of numbered leaves; at most BLOCK members each."""
    member = F.struct((F.col("slot") % BLOCK).cast("int").alias("slot"), "digest", "key")
    packed = leaves.groupBy("tree", F.floor(F.col("slot") / BLOCK).cast("long").alias("block")).agg(
        F.max("n").alias("n"), F.collect_list(member).alias("members")
    )
    # Only places are compared; no two members of a block share one.
    packed = packed.withColumn("members", F.array_sort("members", lambda a, b: (a["slot"] - b["slot"]).cast("int")))
    schema = T.StructType([*packed.schema.fields, T.StructField("nodes", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, sizes = batch.column(batch.schema.get_field_index("members")), batch.column(batch.schema.get_field_index("n"))
            nodes = []
            for m, n in zip(members, sizes.to_pylist()):
                raw = b"".join(m.values.field("digest").to_pylist())
                digests = np.frombuffer(raw, np.uint8).reshape(-1, DIGEST)
                nodes.append(_build(digests, _height(n) if n <= BLOCK else BLOCK_HEIGHT).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, "nodes"])

    return cut_lineage(packed.mapInArrow(build, schema))


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Blocks of numbered leaves, then those of the blocks' roots, and so on until each tree has one block."""
    levels = [_block_table(leaves)]
    while True:
        open_ = levels[-1].filter(F.col("n") > BLOCK)
        if open_.isEmpty():
            return levels
        roots = open_.select(
            "tree",
            F.col("block").alias("slot"),
            F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.substring("nodes", 1, DIGEST).alias("digest"),  # a block's root is stored first
            F.lit(0).alias("key"),
        )
        levels.append(_block_table(roots))


def tree_roots(levels: Sequence[DataFrame]) -> DataFrame:
    """``tree, digest``: the root of every tree."""
    done = [x.filter(F.col("n") <= BLOCK).select("tree", F.substring("nodes", 1, DIGEST).alias("digest")) for x in levels]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


_PATH = T.ArrayType(T.StringType())


def paths(levels: Sequence[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """``tree, slot, digest, key, before, after``: per leaf its siblings on either side, level by level to the root.

    ``above`` (``tree, before, after``) goes on where the trees end, as a tree's path in a tree of trees does.
    """
    found = None
    for at in range(len(levels) - 1, -1, -1):
        blocks = levels[at]
        top, rest = blocks.filter(F.col("n") <= BLOCK), blocks.filter(F.col("n") > BLOCK)
        empty = F.array().cast(_PATH)
        if above is None:
            top = top.withColumns({"before": empty, "after": empty})
        else:
            top = top.join(above.select("tree", "before", "after"), "tree")
        if found is not None:
            up = found.select("tree", F.col("slot").alias("block"), "before", "after")
            top = top.unionByName(rest.join(up, ["tree", "block"]))
        found = _leaf_paths(top)
        if at:
            found = cut_lineage(found.select("tree", "slot", "before", "after"))
    return found


def _leaf_paths(blocks: DataFrame) -> DataFrame:
    member = blocks.schema["members"].dataType.elementType
    names = ["tree", "slot", "digest", "key", "before", "after"]
    schema = T.StructType(
        [
            blocks.schema["tree"],
            T.StructField("slot", T.LongType()),
            member["digest"],
            member["key"],
            T.StructField("before", _PATH),
            T.StructField("after", _PATH),
        ]
    )

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                members = columns["members"][row].values
                leaves, n = len(members), columns["n"][row].as_py()
                height = _height(n) if n <= BLOCK else BLOCK_HEIGHT
                nodes = np.frombuffer(columns["nodes"][row].as_py(), np.uint8).reshape(-1, DIGEST)
                sides = _siblings(nodes, leaves, height) if height else (pa.array([], pa.string()),) * 2
                out = []
                for own, name in zip(sides, ("before", "after")):
                    rest = columns[name][row].values
                    longer = len(rest)
                    # Each leaf's own levels, then the block's: gathered from both lists laid end to end.
                    place = np.arange(height + longer)
                    lines = np.arange(leaves)[:, None] * height + place
                    lines[:, height:] = leaves * height + place[: longer]
                    texts = pa.concat_arrays([own, rest.cast(pa.string())]).take(pa.array(lines.ravel()))
                    ends = np.arange(leaves + 1, dtype=np.int32) * (height + longer)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), texts))
                slots = pa.array(columns["block"][row].as_py() * BLOCK + np.arange(leaves))
                tree = pa.array([columns["tree"][row].as_py()] * leaves, columns["tree"].type)
                yield pa.RecordBatch.from_arrays([tree, slots, members.field("digest"), members.field("key"), *out], names=names)

    narrow = blocks.select("tree", "block", "n", "members", "nodes", "before", "after")
    return narrow.mapInArrow(unfold, schema)


# --- the manifest -------------------------------------------------------------------------


def leaf_text(*columns: str | Column) -> Column:
    """The values one after another, each as its count of UTF-8 bytes, a colon and itself; null as a dash."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def manifest(rows: DataFrame, by: str, order: str, leaf: Column, keep: dict[str, Column]) -> DataFrame:
    """Per row: ``keep`` columns, ``leaf``, ``subroot`` of its group, ``root``, and its path ``before`` / ``after``.

    Leaves (digests as binary) ascend by ``order`` within a group ``by``; groups ascend by their UTF-8 bytes. Digests
    are lower-case hex in the result; ``before`` and ``after`` hold per level the siblings on either side, joined.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    key = F.struct(*[c.alias(name) for name, c in keep.items()])
    leaves = cut_lineage(rows.select(tree.alias("tree"), F.col(order).alias("order"), leaf.alias("digest"), key.alias("key")))
    levels = grown(numbered(leaves, ["order"]))
    groups = tree_roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    forest = grown(numbered(groups, ["key"]))
    above = paths(forest).select(F.col("key").alias("tree"), "before", "after", F.hex("digest").alias("subroot"))
    above = cut_lineage(above)
    top = tree_roots(forest).first()
    root = bytes(top["digest"]).hex() if top else None
    found = paths(levels, above).join(above.select("tree", F.lower("subroot").alias("subroot")), "tree")
    return found.select(
        "key.*", F.lower(F.hex("digest")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "before", "after"
    )


def _levels(row: DataFrame | None = None) -> Column:
    return F.arrays_zip("before", "after")


def path_digest() -> Column:
    """Digest of a path's siblings, level by level, those of a level from left to right."""
    return F.sha2(F.array_join(F.transform(_levels(), lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column) -> Column:
    """The root that a leaf (hex) leads to along the row's path."""
    return F.aggregate(_levels(), leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
