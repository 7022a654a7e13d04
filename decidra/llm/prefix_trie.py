"""Prefix trie of conversations with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns; its name is the depth and the smallest conversation that starts with it. Turns
go into a node's key as 128 bits by place and content, joined by exclusive or, so keys of all depths come from a running
aggregate. Of the children of a node the one with most members goes on its path, so a way from the root changes
paths at most as often as members can be halved. The node at which a path starts is the last light one on the way of any
member. Along a path values are added up from its end in arrays of BLOCK depths; rounds go from the paths behind most light
edges to the root's, and each attaches its paths' totals to the nodes they hang from.

Long conversations are numbered over sorted parts and scanned in blocks of BLOCK turns, so none is in one task. The
list of conversations that end in a node is digested in order from text chunks that a sort by range has made, so a node in which
very many end is sorted by many tasks and only streamed through the last.

Defined cases: null roles and texts are empty; a null turn comes first; turns with the same number follow each other by role and
text; rows without conv_id belong to no conversation; an empty table has no nodes; very long texts enter as hash and
length; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions.arrays import running as running_sums
from .common import written

#: Turns, depths or bytes of text that are held as one.
BLOCK, CHUNK = 4096, 1 << 16
_NOTHING = hashlib.sha256(b"").hexdigest()

Scan = dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, a, b, size): place of each turn, two hashes of role and text, and the code points of the text.

    Rows are sorted by range, so that a conversation may be spread over parts; places are those inside a part plus the rows before.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role, text)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    names = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), F.length("role"), "text", "role").alias("b")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", *names, F.length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("at"))
    ranged = written(ranged.withColumn("part", F.shiftright("at", 33)), "turns")
    parts = ranged.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(written(parts.withColumn("before", before), "parts"), ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "a", "b", "size")


def forked(own: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share a beginning: the first h turns come from the first of each group of ids, h by hash of the id.

    Returns turns (conv, pos, a, b, size) and conversations (conv, n), those without turns too.
    """
    own = written(own, "numbered")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("long")
    sizes = written(own.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    of = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), h.alias("h"))
    of = of.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left")
    of = written(of.select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("shared"), "n"), "forks")
    later = own.join(of, "conv").where("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("shared")).alias("pos"), "a", "b", "size")
    heads = own.where(F.col("i") < most).select(F.col("conv").alias("base"), "i", "a", "b", "size")
    first = of.where("shared > 0").select("conv", "base", "shared").join(heads, "base").where("i < shared").select("conv", F.col("i").alias("pos"), "a", "b", "size")
    return later.union(first), of.select("conv", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def running(rows: DataFrame, key: str, at: str, columns: Scan) -> DataFrame:
    """Each column becomes its aggregate over the rows of the key up to this place, block by block."""
    block = F.floor(F.col(at) / BLOCK).cast("long")
    inside = Window.partitionBy(key, "_block").orderBy(at)
    rest = [c for c in rows.columns if c not in columns]
    blocks = rows.withColumn("_block", block)
    out = blocks.select(*rest, "_block", *[f(F.col(c)).over(inside).alias(c) for c, (f, _) in columns.items()])
    long = rows.where(F.col(at) >= BLOCK).select(key).distinct()
    totals = blocks.join(long, key, "left_semi").groupBy(key, "_block").agg(*[f(F.col(c)).alias(c) for c, (f, _) in columns.items()])
    upto = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_block", *[f(F.col(c)).over(upto).alias(f"_{c}") for c, (f, _) in columns.items()]).where("_block > 0")
    return out.join(before, [key, "_block"], "left").select(*rest, *[combine(F.col(c), F.col(f"_{c}")).alias(c) for c, (_, combine) in columns.items()])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(F.coalesce(b, F.lit(0)))


def _ways(rows: DataFrame) -> DataFrame:
    """(conv, depth, size, k, l, up_k, up_l): the key of each beginning of a conversation and of the one before it."""
    terms = rows.select("conv", (F.col("pos") + 1).alias("depth"), "size", F.xxhash64("pos", "a", "b").alias("s"), F.xxhash64(F.lit(2), "b", "pos", "a").alias("t"))
    keyed = running(terms.withColumns({"k": F.col("s"), "l": F.col("t")}), "conv", "depth", {"k": (F.bit_xor, _xor), "l": (F.bit_xor, _xor)})
    return keyed.select("conv", "depth", "size", "k", "l", F.col("k").bitwiseXOR(F.col("s")).alias("up_k"), F.col("l").bitwiseXOR(F.col("t")).alias("up_l"))


def _linked(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes (depth, k, l, conv_id, n_convs, size, n_children, parent_conv_id, light), the root with k = l = 0."""
    inner = ways.groupBy("depth", "k", "l").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("up_k").alias("up_k"), F.max("up_l").alias("up_l"))
    top = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(0).cast("long")
    nodes = written(inner.unionByName(top.select(none.alias("depth"), none.alias("k"), none.alias("l"), "conv_id", "n_convs", none.alias("size"), F.lit(None).cast("long").alias("up_k"), F.lit(None).cast("long").alias("up_l"))), "nodes")
    largest = F.min(F.struct(-F.col("n_convs"), "conv_id"))["conv_id"]
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_k").alias("k"), F.col("up_l").alias("l")).agg(F.count("*").alias("n_children"), largest.alias("heavy"))
    nodes = written(nodes.join(written(kids, "kids"), ["depth", "k", "l"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k").alias("up_k"), F.col("l").alias("up_l"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    return nodes.join(parents, ["depth", "up_k", "up_l"], "left").select("depth", "k", "l", "conv_id", "n_convs", "size", "n_children", "parent_conv_id", F.coalesce(F.col("chosen") != F.col("conv_id"), F.lit(True)).alias("light"))


def _paths(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with their path (the node at which it starts, head) and its level, the number of light edges above it.

    The way of a node's smallest member tells both: the last light node up to the depth, and how many there are.
    """
    flagged = ways.select("conv", "depth", "k", "l").join(nodes.select("depth", "k", "l", "conv_id", "light"), ["depth", "k", "l"])
    marks = flagged.select("conv", "depth", "conv_id", F.col("light").cast("long").alias("level"), F.when(F.col("light"), F.struct("depth", "conv_id")).alias("head"))
    found = running(marks, "conv", "depth", {"level": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "head": (F.max, lambda a, b: F.coalesce(a, b))})
    found = found.where("conv = conv_id").select("depth", "conv_id", "level", "head")
    root = nodes.where("depth = 0").select(F.struct("depth", "conv_id").alias("top"))  # one row
    return nodes.drop("k", "l", "light").join(found, ["depth", "conv_id"], "left").join(F.broadcast(root)).select("*", F.coalesce("head", "top").alias("path")).drop("head", "top").na.fill(0, ["level"])


def _along(level: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of the columns from each node to its path's end: along arrays of BLOCK depths, with the sums of the blocks behind."""
    node = F.struct((-F.col("depth")).alias("up"), "conv_id", *columns)
    blocks = level.withColumn("block", F.floor(F.col("depth") / BLOCK)).groupBy("path", "block").agg(F.array_sort(F.collect_list(node)).alias("nodes"), *[F.sum(c).alias(c) for c in columns])
    behind = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "nodes", *[F.coalesce(F.sum(c).over(behind), F.lit(0)).alias(c) for c in columns])

    def sums(c: str) -> Column:
        return F.transform(running_sums(F.transform("nodes", lambda x: x[c]), lambda a, b: a + b, "bigint"), lambda x: x + F.col(c)).alias(c)

    placed = blocks.select("path", F.arrays_zip("nodes", *map(sums, columns)).alias("placed")).select("path", F.explode("placed").alias("x"))
    return placed.select("path", (-F.col("x.nodes.up")).alias("depth"), "x.nodes.conv_id", *[F.col(f"x.{c}").alias(c) for c in columns])


def subtrees(paths: DataFrame, columns: list[str]) -> DataFrame:
    """(depth, conv_id, columns): sums over each node's subtree, a round for each level from the last to the root's."""
    paths = written(paths, "paths")
    last = paths.agg(F.max("level")).first()[0]
    done, hanging = [], None
    for level in range(-1 if last is None else last, -1, -1):
        here = paths.where(F.col("level") == level).select("path", "depth", "conv_id", "parent_conv_id", *columns)
        own = here.drop("parent_conv_id")
        if hanging is not None:
            more = hanging.select((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"), *[F.col(c).alias(f"_{c}") for c in columns])
            more = more.groupBy("depth", "conv_id").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in columns])
            own = own.join(more, ["depth", "conv_id"], "left").select("path", "depth", "conv_id", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns])
        sums = written(_along(own, columns), "level")
        done.append(sums.drop("path"))
        heads = here.where((F.col("path.depth") == F.col("depth")) & (F.col("path.conv_id") == F.col("conv_id"))).select("depth", "conv_id", "parent_conv_id")
        hanging = sums.where((F.col("path.depth") == F.col("depth")) & (F.col("path.conv_id") == F.col("conv_id"))).drop("path").join(heads, ["depth", "conv_id"])
    out = done[0] if done else paths.select("depth", "conv_id", *columns)
    for part in done[1:]:
        out = out.union(part)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that end in a node, in order, as texts of about CHUNK bytes."""
    node, first, parts, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, first)] + [pa.array([",".join(parts)])], names=["depth", "conv_id", "first", "chunk"])

    for batch in batches:
        for depth, owner, conv in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if parts and (node != (depth, owner) or size > CHUNK):
                yield out()
                parts, size = [], 0
            if not parts:
                node, first = (depth, owner), conv
            parts.append(str(conv))
            size += len(parts[-1]) + 1
    if parts:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order."""
    node, digest = None, None
    for batch in batches:
        done = []
        for depth, owner, chunk in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if node == (depth, owner):
                digest.update(b",")
            else:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, owner), hashlib.sha256()
            digest.update(chunk.encode())
        if done:
            yield _named(done)
    if node:
        yield _named([(*node, digest.hexdigest())])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "conv_id", "ends"])


def ends(at: DataFrame) -> DataFrame:
    """(depth, conv_id, ends) from rows (depth, conv_id, conv): the digest of the ids that end in a node, in order of number."""
    order = ["depth", "conv_id", "conv"]
    chunks = at.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, conv_id long, first long, chunk string")
    return written(chunks, "chunks").repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(_digests, "depth long, conv_id long, ends string")


def prefix_trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations: turns (conv, pos, a, b, size) and conversations (conv, n).

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. saved_tokens is what a
    cache of the turns would save: code points of a node's last text for each member but the first, over its subtree.
    """
    members = written(members, "members")
    ways = written(_ways(rows), "ways")
    nodes = written(_linked(ways, members), "linked")
    paths = _paths(ways, nodes).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")})
    sums = subtrees(paths, ["n_leaves", "saved_tokens"])
    last = ways.select("conv", "depth", "k", "l").join(members.select("conv", F.col("n").alias("depth")), ["conv", "depth"])
    none = members.where("n = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("l"))
    digests = ends(last.unionByName(none).join(nodes.select("depth", "k", "l", "conv_id"), ["depth", "k", "l"]))
    out = nodes.join(sums, ["depth", "conv_id"]).join(digests, ["depth", "conv_id"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"))
