"""Episodes: histories, sticky and current goals, earlier and later steps, layouts of packed sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions.arrays import running
from decidra.sources.scratch import stored

from .ordered import grouped, numbered

#: Steps of an episode in one array, and places of a shard in one block.
BLOCK, SPAN = 4096, 1024


def history(rows: DataFrame, episode: list[str], step: str, entry: str, last: int = 10) -> DataFrame:
    """The steps of an episode before each one as a range: their number, and the last entries themselves.

    `before` counts the steps before, so a history is the entries [0, before) of history_chunks, which are stored once;
    `recent` holds the last of them. Rows are numbered over sorted parts and looked at in blocks of BLOCK steps, each with
    the last steps of the block before.
    """
    placed = numbered(rows, episode, step, "before")
    entries = placed.select(F.struct(F.lit(0), *episode).alias("_g"), F.col("before").alias("_at"), F.col(entry).alias("_entry"), F.struct(*rows.columns).alias("_row"))
    block = F.floor(F.col("_at") / BLOCK)
    guests = entries.where(F.col("_at") % BLOCK >= BLOCK - last).select("_g", "_at", "_entry", F.lit(None).cast(entries.schema["_row"].dataType).alias("_row"), (block + 1).alias("_block"))
    both = entries.withColumn("_block", block).unionByName(guests)
    seen = F.collect_list(F.struct("_entry")).over(Window.partitionBy("_g", "_block").orderBy("_at").rowsBetween(-last, -1))
    return both.withColumn("recent", F.transform(seen, lambda x: x["_entry"])).where("_row is not null").select("_row.*", F.col("_at").alias("before"), "recent")


def histories(rows: DataFrame, episode: list[str], step: str, entry: str) -> DataFrame:
    """All entries before each step, in order, as `history`, and their number as `before`.

    An episode of n steps has n * n / 2 entries to write. Its chunks of BLOCK entries are shuffled once for each later chunk,
    which is a BLOCK-th of that; a row's history is the chunks before its own, which its block shares, and the entries of
    the block before it. A task holds one history at a time besides the rows of a block.
    """
    placed, block = numbered(rows, episode, step, "before"), F.floor(F.col("before") / BLOCK)
    entries = placed.select(F.struct(F.lit(0), *episode).alias("_g"), block.alias("_block"), F.col("before").alias("_at"), F.struct(F.col(entry).alias("entry")).alias("_entry"), F.struct(*rows.columns).alias("_row"))
    entries = stored(entries)  # its keys are then of the same type as the chunks', so histories are joined where they are made
    chunks = entries.groupBy("_g", "_block").agg(F.array_sort(F.collect_list(F.struct("_at", "_entry"))).alias("_all"))
    chunks = stored(chunks.select("_g", "_block", F.transform("_all", lambda x: x["_entry"]).alias("_entries")))
    earlier = chunks.select("_g", F.col("_block").alias("_chunk"), "_entries")
    before = chunks.select("_g", "_block").join(earlier, "_g").where("_chunk < _block").groupBy("_g", "_block")
    before = before.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_entries"))), lambda x: x["_entries"])).alias("_before"))
    own = F.collect_list("_entry").over(Window.partitionBy("_g", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    both = entries.withColumn("_own", own).join(before, ["_g", "_block"], "left")
    history = F.concat(F.coalesce("_before", F.array().cast(before.schema["_before"].dataType)), "_own")
    return both.select("_row.*", F.col("_at").alias("before"), F.transform(history, lambda x: x["entry"]).alias("history"))


def history_chunks(rows: DataFrame, episode: list[str], step: str, entry: str) -> DataFrame:
    """Entries of an episode in order, in arrays of up to BLOCK: episode, chunk and entries. Each entry is stored once."""
    placed = numbered(rows, episode, step, "_at").withColumn("chunk", F.floor(F.col("_at") / BLOCK))
    listed = placed.groupBy(*episode, "chunk").agg(F.array_sort(F.collect_list(F.struct("_at", F.col(entry).alias("entry")))).alias("_all"))
    return listed.select(*episode, "chunk", F.transform("_all", lambda x: x["entry"]).alias("entries"))


def sticky(rows: DataFrame, episode: list[str], step: str, flag: str, name: str) -> DataFrame:
    """Whether the flag was ever set up to the step."""
    return rows.withColumn(name, F.max(flag).over(Window.partitionBy(*episode).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def first_step(rows: DataFrame, episode: list[str], step: str, condition: Column) -> DataFrame:
    return rows.groupBy(*episode).agg(F.min(F.when(condition, F.col(step))).alias("first_step"))


def previous(rows: DataFrame, episode: list[str], step: str, columns: list[str]) -> DataFrame:
    """Columns of exactly the step before, as prev_...; after a gap they are null (a lag would take the wrong row)."""
    earlier = rows.select(*episode, (F.col(step) + 1).alias(step), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return rows.join(earlier, [*episode, step], "left")


def last_seen(rows: DataFrame, episode: list[str], step: str, value: str) -> DataFrame:
    """The last step of each value of an episode. A value occurs after a step if its last step is later: every set of later values in one table."""
    return rows.where(F.col(value).isNotNull()).groupBy(*episode, value).agg(F.max(step).alias("last"))


def later_values(rows: DataFrame, episode: list[str], step: str, value: str, name: str) -> DataFrame:
    """Distinct values of the steps after each one, from the last steps of the values: one array per episode, of its distinct values."""
    last = grouped(last_seen(rows, episode, step, value), episode).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), "last"))).alias("_last"))
    joined = grouped(rows, episode).join(stored(last), "_g", "left")
    later = F.transform(F.filter("_last", lambda x: x["last"] > F.col(step)), lambda x: x["value"])
    return joined.withColumn(name, F.coalesce(later, F.array().cast(later_type(rows, value)))).drop("_g", "_last")


def later_type(rows: DataFrame, value: str) -> str:
    return f"array<{dict(rows.dtypes)[value]}>"


def running_mean(rows: DataFrame, series: list[str], step: str, value: str, n: int) -> DataFrame:
    return rows.withColumn("running_mean", F.avg(value).over(Window.partitionBy(*series).orderBy(step).rowsBetween(1 - n, 0)))


def packed(rows: DataFrame, state: str, questions: str) -> DataFrame:
    """Layout of a state and its questions: segments, positions that restart after the state, and readout places.

    state is a number of tokens; questions is an array of structs with tokens (of the instructions) and options (tokens of
    each). A question takes one mark, its instructions, two marks and the text for each option, and a readout mark.
    """
    size = lambda q: F.aggregate(q["options"], q["tokens"] + 2, lambda a, o: a + o + 2)
    add = lambda a, b: a + b
    sizes, n = F.transform(questions, size), F.col(state)
    ends = F.transform(running(sizes, add), lambda x: x + n)
    starts = F.zip_with(ends, sizes, lambda e, s: e - s)
    ranges = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    segments = F.concat(F.array_repeat(F.lit(0), n), F.flatten(F.transform(sizes, lambda s, i: F.array_repeat(i + 1, s))))
    positions = F.concat(ranges(n), F.flatten(F.transform(sizes, lambda s: F.transform(ranges(s), lambda k: k + n))))
    reads = F.transform(ends, lambda e: e - 1)
    marks = lambda q, start: F.transform(running(F.transform(q["options"], lambda o: o + 2), add), lambda x: x + start + q["tokens"])
    options = F.zip_with(questions, starts, marks)
    return rows.select("*", segments.alias("segments"), positions.alias("positions"), reads.alias("reads"), options.alias("option_ends"))


def segment_ranges(places: DataFrame, key: list[str], place: str, segment: str) -> DataFrame:
    """Segments of sequences, of which each is a run of places: key, segment, start and stop (excluded). The state is segment 0."""
    return places.groupBy(*key, segment).agg(F.min(place).alias("start"), (F.max(place) + 1).alias("stop"))


def allowed(segments: DataFrame, key: list[str]) -> DataFrame:
    """How many pairs (i, j) of a sequence are allowed: j not later than i, and of the same segment or the state, which comes first.

    A place sees the range of the state and that of its own segment up to itself, so a segment of n places adds n (n + 1) / 2
    pairs and n for each place of the state.
    """
    size = (F.col("stop") - F.col("start")).cast("long")
    state = F.sum(F.when(F.col("segment") == 0, size).otherwise(0))
    others = F.sum(F.when(F.col("segment") == 0, 0).otherwise(size))
    own = F.sum((size * (size + 1) / 2).cast("long"))
    return segments.groupBy(*key).agg((own + state * others).alias("allowed"))


def mask_ranges(segments: DataFrame, key: list[str]) -> DataFrame:
    """What each place i may look at, as two ranges (ends excluded): key, i, state_stop, start and stop."""
    state = segments.where("segment = 0").select(*key, F.col("stop").alias("_state"))
    joined = segments.alias("s").join(state.alias("t"), [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key], "left").select("s.*", F.coalesce("t._state", F.lit(0)).alias("_state"))
    each = joined.withColumn("i", F.explode(F.sequence("start", F.col("stop") - 1)))
    return each.select(*key, "i", F.when(F.col("segment") == 0, 0).otherwise(F.col("_state")).alias("state_stop"), "start", (F.col("i") + 1).alias("stop"))


def attends(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (i, j) of mask_ranges, for sequences short enough to be written out."""
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    number = lambda c: F.col(c).cast("int")
    return ranges.select(*key, "i", F.explode(F.concat(span(F.lit(0), number("state_stop")), span(number("start"), number("stop")))).alias("j"))


def length_batches(rows: DataFrame, shard: str, key: str, size: str, budget: int, most: int) -> DataFrame:
    """Batches within a shard, filled in order of size while padded tokens stay under the budget and rows under most.

    Sizes grow within a shard, so where a batch that begins at a row would end depends on the next `most` rows only. Rows lie
    in blocks of SPAN places (most, if that is more); for each place at which a batch may cross into a block, a fold from the block's end gives the place
    in the next block and the number of batches on the way. These maps of blocks are composed by doubling joins, which
    gives every block its first batch, and a fold through the block numbers its rows. No task holds more than a block.
    """
    span = max(SPAN, most)
    placed = stored(numbered(rows.select(shard, key, size), [shard], [size, key], "at").withColumn("_g", F.struct(F.lit(0), shard)))
    block = F.floor(F.col("at") / span)
    guests = placed.where(F.col("at") % span < most).where(F.col("at") >= span).select("_g", "at", (block - 1).alias("block"), F.col(size).alias("size"))
    own = placed.select("_g", "at", block.alias("block"), F.col(size).alias("size"))
    blocks = own.union(guests).groupBy("_g", "block").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("rows"))
    end = (F.col("block") + 1) * span

    def following(x: Column, i: Column) -> Column:
        """The first place of the next batch if one begins at place i of the block."""
        ahead = F.slice("rows", i + 1, most)
        n = F.size(F.filter(F.transform(ahead, lambda y, m: y["size"] * (m + 1) <= budget), lambda ok: ok))
        return x["at"] + F.greatest(F.lit(1), n)

    nexts = F.transform("rows", lambda x, i: F.struct(x["at"].alias("at"), following(x, i).alias("next")))
    blocks = stored(blocks.select("_g", "block", F.filter(nexts, lambda x: x["at"] < end).alias("rows")))
    state = "array<struct<out:bigint,n:bigint>>"
    step = lambda a, x: F.concat(F.array(F.when(x["next"] >= end, F.struct(x["next"].alias("out"), F.lit(1).cast("long").alias("n"))).otherwise(F.struct(F.get(a, (x["next"] - x["at"] - 1).cast("int"))["out"].alias("out"), (F.get(a, (x["next"] - x["at"] - 1).cast("int"))["n"] + 1).alias("n")))), a)
    exits = F.slice(F.aggregate(F.reverse("rows"), F.array().cast(state), step), 1, most)
    maps = blocks.select("_g", "block", F.posexplode(exits).alias("entry", "x")).select("_g", "block", F.col("entry").cast("long").alias("entry"), (F.col("block") + 1).alias("to"), (F.col("x.out") - end).alias("into"), F.col("x.n").alias("n"))
    jumps = stored(maps)
    known = stored(blocks.where("block = 0").select("_g", "block", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("first")))
    last, reach = placed.agg(F.max(block)).first()[0] or 0, 1
    while reach <= last:
        hop = known.join(jumps, ["_g", "block", "entry"]).select("_g", F.col("to").alias("block"), F.col("into").alias("entry"), (F.col("first") + F.col("n")).alias("first"))
        known = stored(known.union(hop))
        reach *= 2
        if reach <= last:
            then = jumps.select("_g", F.col("block").alias("to"), F.col("entry").alias("into"), F.col("to").alias("_to"), F.col("into").alias("_into"), F.col("n").alias("_n"))
            jumps = stored(jumps.join(then, ["_g", "to", "into"]).select("_g", "block", "entry", F.col("_to").alias("to"), F.col("_into").alias("into"), (F.col("n") + F.col("_n")).alias("n")))
    begun = F.struct((F.col("block") * span + F.col("entry")).alias("next"), (F.col("first") - 1).alias("batch"), F.array().cast("array<bigint>").alias("out"))
    number = lambda a, x: F.when(x["at"] == a["next"], F.struct(x["next"].alias("next"), (a["batch"] + 1).alias("batch"), F.concat(a["out"], F.array(a["batch"] + 1)).alias("out"))).otherwise(F.struct(a["next"].alias("next"), a["batch"].alias("batch"), F.concat(a["out"], F.array(a["batch"])).alias("out")))
    marked = blocks.join(known, ["_g", "block"]).select("_g", F.explode(F.arrays_zip(F.transform("rows", lambda x: x["at"]).alias("at"), F.aggregate("rows", begun, number)["out"].alias("batch"))).alias("x"))
    return placed.join(marked.select("_g", "x.at", "x.batch"), ["_g", "at"]).select(shard, key, size, "batch")


def balanced(rows: DataFrame, shard: str, group: str, order: str, label: str, per_group: int, slack: int) -> DataFrame:
    """Rows kept in order while neither answer is more than slack ahead and a group has room.

    A kept row changes later decisions, so a shard is read by one task, in order and in Arrow batches; its state is two
    counts and the groups'. Maps of blocks, as length_batches composes them, would need an entry for every state that a block
    may begin with, and with a count for each group those are more than the rows.
    """
    frame = rows.select(shard, group, order, label)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, counts, taken = object(), {0: 0, 1: 0}, {}
        for frame in batches:
            flags = []
            for s, g, y in zip(frame[shard].tolist(), frame[group].tolist(), frame[label].tolist(), strict=True):
                if s != last:
                    last, counts, taken = s, {0: 0, 1: 0}, {}
                ok = counts[y] <= counts[1 - y] + slack and taken.get(g, 0) < per_group
                if ok:
                    counts[y] += 1
                    taken[g] = taken.get(g, 0) + 1
                flags.append(ok)
            yield frame[flags]

    return frame.repartition(shard).sortWithinPartitions(shard, order).mapInPandas(keep, frame.schema)
