"""Chat formatting from reply trees, with DataFrame functions only.

Nodes of a tree name their parent. Self-joins that double the way up each time give every node its root's distance and score;
branches are ranked by score, and the nodes of the chosen paths come from the same hops, the longest last. Each path becomes one
conversation. In the output a turn is `<|im_start|>role<|im_sep|>text<|im_end|>` and a line end. Inside roles and texts a backslash
is doubled and `<|` becomes `<\\|`, so no control string can occur in them, and unescaping gives back every text.

Defined cases: null roles and texts count as empty; turns with the same number follow each other by role and text;
a null turn comes first; a node whose parent is missing is a root; nodes on a cycle belong to no path.
An empty table gives no conversations; very long texts are joined to the paths last; branches of equal score and length rank by
their leaf; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions.arrays import running

from .common import written

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def chain(turns: DataFrame, tree: str, turn: str) -> DataFrame:
    """Conversations as trees of one branch: each turn answers the one before it."""
    order = Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_first(), "role", "text")
    nodes = turns.select(F.col(tree).alias("tree"), F.row_number().over(order).alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes that hang from a root (tree, node, size, total: nodes and score from the root to it), and hops (tree, node, up).

    The k-th table of hops leads 2 ** k nodes up. Each round is one self-join of scalars; a way that has not ended
    after as many nodes as its tree has leads into a cycle and belongs to no root.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))  # a parent that doesn't exist is none
    links = nodes.select("tree", "node", "parent", "score").join(known, ["tree", "parent"], "left")
    links = links.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("size"), F.coalesce("score", F.lit(0.0)).alias("total"))
    now, hops, over = written(links, "links"), [], []
    most = now.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while True:
        over.append(now.where("up is null"))
        hops.append(now.where("up is not null").select("tree", "node", "up"))
        if 1 << len(hops) > 2 * most or not hops[-1].limit(1).count():
            break
        ahead = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("size").alias("more"), F.col("total").alias("above"))
        longer = now.where("up is not null").join(reduce(DataFrame.union, [ahead, *[x.select("tree", "node", "up", "size", "total") for x in over[:-1]]]), ["tree", "up"])
        now = written(longer.select("tree", "node", F.col("next").alias("up"), (F.col("size") + F.col("more")).alias("size"), (F.col("above") + F.col("total")).alias("total")), "jumps")
    return reduce(DataFrame.union, over).select("tree", "node", "size", "total"), hops


def paths(leaves: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """Rows of leaves (tree, leaf, size and others) for each node on the way to the root, with node and at (the root is 1).

    Each round adds the nodes twice as far up, so rows are as many as the paths have nodes.
    """
    rest = [c for c in leaves.columns if c not in ("tree", "node", "at")]
    steps = leaves.select("tree", *rest, F.col("leaf").alias("node"), F.col("size").alias("at"))
    for k, hop in enumerate(hops[:-1]):
        higher = steps.join(hop, ["tree", "node"]).select("tree", *rest, F.col("up").alias("node"), (F.col("at") - (1 << k)).alias("at"))
        steps = written(steps.union(higher), "steps")
    return steps


def formatted(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """One row per chosen path of each tree: tree, leaf, rank, turns, output and loss.

    Branches rank by the mean score of their nodes, then by length and leaf; best keeps that many of each tree.
    loss lists the spans of the assistants' texts in the output (1-based start and length, code points).
    """
    nodes = written(nodes.select("tree", "node", "parent", "role", "text", "score"), "nodes")
    hung, hops = jumps(nodes)
    leaves = hung.join(hops[0].select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("size")), F.desc("size"), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    steps = paths(written(chosen.select("tree", "leaf", "rank", "size"), "leaves"), hops)
    rows = steps.select("tree", "leaf", "rank", "at", "node").join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    turn = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP), escaped(F.col("text")), F.lit(END))
    parts = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("role") == "assistant").alias("learned"), F.length(escaped(F.col("text"))).alias("size"), turn.alias("turn")))).alias("turns"))
    ends = running(F.transform("turns", lambda x: F.length(x["turn"])), lambda a, b: a + b)
    placed = F.zip_with("turns", ends, lambda x, end: F.struct(x["learned"].alias("learned"), (end - len(END) - x["size"] + 1).alias("start"), x["size"].alias("size")))
    loss = F.transform(F.filter(placed, lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size")))
    return parts.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("turns"), F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("output"), loss.alias("loss"))


def read_turns(output: Column) -> Column:
    """(role, text) of each turn, from the output."""
    pieces = F.slice(F.split(output, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(x: Column) -> Column:
        at = F.instr(x, SEP)
        return F.struct(unescaped(F.substring(x, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(x, at + len(SEP), F.length(x) - at - len(SEP) + 1 - len(END))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(output: Column, loss: Column) -> Column:
    """The text under the loss mask, from the output."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(output, x["start"], x["size"]))), "")
