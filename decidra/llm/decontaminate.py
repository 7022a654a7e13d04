"""Benchmark decontamination with a positional inverted index over the training texts.

The index is stored in shards, once for all benchmarks. A shard holds the texts of one batch of a task: its words, and for
each its positions in the shard, where texts follow each other with a gap wider than a window, so that no match crosses
a text. A window of a benchmark is looked up from its rarest term (by the count over the whole index), in the shards that
hold this term: its postings, moved by its offset, are the candidate starts, and the postings of the other terms, rarest
first, are intersected with them. The windows are sent to the shards in blocks of bounded size, so the postings never
move and no list of a frequent term meets in one task.

Defined cases: null and empty texts have no words; an item without words has no window; repeated items are matched
each; rows with the same doc_id are separate rows; an empty benchmark hits nothing. A near match counts once for an item.
An empty table of documents gives no rows; a very long text is one row, read whole by one task; other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bytes_of, unused, with_row_id, written

WINDOW = 10
#: Words by which the terms of a window may stand further apart in the registered query's proximity matches.
REACH = 5
#: Words of benchmark text in one block of windows, and words of training text in one shard.
BLOCK_WORDS, SHARD_WORDS = 500_000, 1_500_000

_INDEX = "rids array<long>, docs array<long>, sizes array<int>, words binary, counts binary, postings binary"


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Block:
    """Windows of some benchmark items: distinct windows as term numbers (-1 after a short one's end), and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in windows_of(alnum_words(text), size):
                found.setdefault(window, set()).add(item)
        self.terms = {w: i for i, w in enumerate(sorted({w for window in found for w in window}))}
        self.windows = np.full((len(found), size), -1, np.int32)
        for row, window in zip(self.windows, found, strict=True):
            row[: len(window)] = [self.terms[w] for w in window]
        self.items = [tuple(sorted(x)) for x in found.values()]


class Plans:
    """Windows by their rarest term, and the numbers of all terms."""

    def __init__(self, block: Block, counts: np.ndarray) -> None:
        self.terms, self.counts = block.terms, counts
        shown = np.append(counts, np.iinfo(np.int64).max)[block.windows]  # a number of -1 is the last
        rarest = block.windows[np.arange(len(shown)), np.lexsort((block.windows.T, shown.T), axis=0)[0]] if len(shown) else np.empty(0, np.int32)
        order = np.argsort(rarest, kind="stable")
        self.rarest, self.windows, self.items = rarest[order], block.windows[order], [block.items[i] for i in order.tolist()]

    def of(self, term: int) -> Iterator[tuple[list[tuple[int, int]], int, tuple[str, ...]]]:
        """For each window with this rarest term: (term, offset) from the rarest on, its length, and its items."""
        a, b = np.searchsorted(self.rarest, (term, term + 1)).tolist()
        for k in range(a, b):
            own = [(t, i) for i, t in enumerate(self.windows[k].tolist()) if t >= 0]
            yield sorted(own, key=lambda x: (self.counts[x[0]], x)), len(own), self.items[k]


def blocks_of(benchmark: DataFrame, size: int, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of at most about limit words; rows come to the driver one after another."""
    items, words = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        body = (text or "").encode()
        items.append(("" if item is None else item, body))
        words += len(body) // 4
        if words >= limit:
            yield Block(items, size)
            items, words = [], 0
    if items:
        yield Block(items, size)


def _indexed(gap: int, shard: int):
    """Shards of texts: their words, counts and positions (as differences, by word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in _INDEX.split(", ")]

        def closed(rids: list, docs: list, sizes: list, parts: list[np.ndarray], number: dict[bytes, int]) -> pa.RecordBatch:
            at = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + gap)[:-1]))
            ids = np.concatenate([np.empty(0, np.int32), *parts])
            place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) + a for x, a in zip(parts, at, strict=True))])
            steps = np.diff(place[np.argsort(ids, kind="stable")], prepend=0).astype(np.int32)
            row = [[rids], [docs], [sizes], [b" ".join(number)], [np.bincount(ids, minlength=len(number)).astype(np.int32).tobytes()], [steps.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)

        rids, docs, sizes, parts, held, number = [], [], [], [], 0, {}
        for batch in batches:
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2)), strict=True):
                words = alnum_words(text)
                rids.append(rid)
                docs.append(doc)
                sizes.append(len(words))
                parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                held += len(words) + gap
                if held >= shard:
                    yield closed(rids, docs, sizes, parts, number)
                    rids, docs, sizes, parts, held, number = [], [], [], [], 0, {}
        if rids:
            yield closed(rids, docs, sizes, parts, number)

    return run


def _inside(starts: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, starts)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == starts


def phrase(lists: dict[int, np.ndarray], plan: list[tuple[int, int]]) -> np.ndarray:
    """Starts at which all terms stand at their offsets; plan begins with the rarest."""
    term, offset = plan[0]
    if term not in lists:
        return np.empty(0, np.int64)
    starts = lists[term] - offset
    for term, offset in plan[1:]:
        if not len(starts) or term not in lists:
            return np.empty(0, np.int64)
        starts = starts[_inside(starts + offset, lists[term])]
    return starts


def proximity(lists: dict[int, np.ndarray], plan: list[tuple[int, int]], reach: int) -> np.ndarray:
    """Places of the rarest term that have every other term of the window at most reach words away."""
    if any(t not in lists for t, _ in plan):
        return np.empty(0, np.int64)
    places = lists[plan[0][0]]
    for term, _ in plan[1:]:
        other = lists[term]
        at = np.searchsorted(other, places)
        left = np.where(at > 0, places - other[np.maximum(at - 1, 0)], reach + 1)
        right = np.where(at < len(other), other[np.minimum(at, len(other) - 1)] - places, reach + 1)
        places = places[np.minimum(left, right) <= reach]
    return places


def _searched(plans, gap: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plans.value
        number = plan.terms.get
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                base = np.concatenate(([0], np.cumsum(sizes + gap)))
                places = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int64)
                cuts = np.concatenate(([0], np.cumsum(np.frombuffer(row["counts"], np.int32), dtype=np.int64)))
                lists = {t: places[cuts[i] : cuts[i + 1]] for i, w in enumerate(row["words"].split()) if (t := number(w)) is not None}
                edge, found, near = np.zeros(base[-1] + 1, np.int32), {}, {}
                for terms, length, names in (window for term in lists for window in plan.of(term)):
                    starts = phrase(lists, terms)
                    if len(starts):
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + length, -1)
                        for d in np.unique(np.searchsorted(base, starts, "right") - 1).tolist():
                            found.setdefault(d, set()).update(names)
                    if reach and len(starts := proximity(lists, terms, length - 1 + reach)):
                        for d in np.unique(np.searchsorted(base, starts, "right") - 1).tolist():
                            near.setdefault(d, set()).update(names)
                hit = np.cumsum(edge) > 0
                flips = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
                spans: dict[int, list[int]] = {}
                for a, b in flips.reshape(-1, 2).tolist():
                    d = int(np.searchsorted(base, a, "right")) - 1
                    spans.setdefault(d, []).extend((a - int(base[d]), b - int(base[d])))
                n = range(len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["rids"], pa.int64()),
                        pa.array(row["docs"], pa.int64()),
                        pa.array(sizes),
                        pa.array([spans.get(d, []) for d in n], pa.list_(pa.int64())),
                        pa.array([sorted(found.get(d, ())) for d in n], pa.list_(pa.string())),
                        pa.array([sorted(near.get(d, ())) for d in n], pa.list_(pa.string())),
                    ],
                    names=["_rid", "doc_id", "n_words", "spans", "items", "near_items"],
                )

    return run


_FOUND = "_rid long, doc_id long, n_words long, spans array<long>, items array<string>, near_items array<string>"


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, reach: int = 0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of docs (_rid, doc_id, text): n_words, spans (start, end, start, end ... in words, exact phrases), items.

    reach > 0 also fills near_items: items one of whose windows has all its terms around an occurrence of its
    rarest term, at most reach words further apart than in the window.
    """
    spark, out = docs.sparkSession, []
    index = written(docs.select("_rid", "doc_id", "text").mapInArrow(_indexed(size + reach, shard_words), _INDEX), "postings")
    for block in blocks_of(benchmark, size, block_words):
        totals = np.zeros(len(block.terms), np.int64)
        for term, n in _frequencies(index, spark.sparkContext.broadcast(block.terms)).toLocalIterator():
            totals[term] = n
        plans = spark.sparkContext.broadcast(Plans(block, totals))
        out.append(index.mapInArrow(_searched(plans, size + reach, reach), _FOUND))
    if not out:
        plans = spark.sparkContext.broadcast(Plans(Block([], size), np.zeros(0, np.int64)))
        return index.mapInArrow(_searched(plans, size + reach, 0), _FOUND)
    if len(out) == 1:
        return out[0]
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return _joined(every)


def _frequencies(index: DataFrame, terms) -> DataFrame:
    """Occurrences of each term of the block over all shards; only words and counts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value.get
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(t, i) for i, w in enumerate(words.split()) if (t := number(w)) is not None]
                counts = np.frombuffer(counts, np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array(counts[[i for _, i in found]])], names=["term", "n"])

    return index.select("words", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _joined(found: DataFrame) -> DataFrame:
    """Results of several blocks for the same texts as one: spans merged where they touch or overlap."""

    def merged(lists: list[list[int]]) -> list[int]:
        out: list[int] = []
        for a, b in sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            x["spans"] = pa.array([merged(s) for s in x["spans"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) if not isinstance(v, pa.Array) else v for v, t in zip(x.values(), (pa.int64(), pa.int64(), pa.int64(), None, pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], names=list(x))

    grouped = found.groupBy("_rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.collect_list("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    return grouped.mapInArrow(run, _FOUND)


def hit_words(spans: str = "spans") -> F.Column:
    """Words in the spans."""
    signed = F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of a benchmark item; columns as before."""
    key = unused(docs, "_rid")
    numbered = with_row_id(docs, key)
    found = matches(numbered.select(F.col(key).alias("_rid"), "doc_id", "text"), benchmark, size)
    hit = found.where(F.size("items") > 0).select(F.col("_rid").alias(key))
    return numbered.join(hit, key, "left_anti").select(docs.columns)
