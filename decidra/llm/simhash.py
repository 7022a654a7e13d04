"""SimHash near-duplicates found through an embedding of the fingerprints by segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits. Its image has in each segment the number of set bits
(in unary: 00, 01, 11), so the Manhattan distance of two count vectors is the number of bits in which their
images differ, and it never exceeds the Hamming distance of the fingerprints. The 32 coordinates form
`groups` groups; if two count vectors are within d, at least groups - d groups agree. Each fingerprint is
entered into one unit cell of the grid over every choice of groups - d coordinate groups, where the range to join is
the cell itself; pairs that share a cell are tested by the Manhattan bound and then exactly.

A cell's members are first tested against its smallest, so a group of near copies costs as many tests as it has members.
Those that it does not reach meet the others in pairs of blocks. What a block pair knows to be connected is one part from
the start, and it returns only edges between different parts; edges inside a block come from one of its pairs alone.

Defined cases: null and empty texts have no words and fingerprint 0; a text of fewer words than a shingle is one
shingle; rows with the same doc_id are separate rows; a null doc_id never names a component unless all are null.
An empty table gives no rows; a very long text is one row, read whole by one task; bits set in exactly half the shingles are 0;
other columns are not read by the query, and near_copies returns them as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, bytes_of, discard, small, unused, with_row_id, written
from .graph import components

SEED, SEGMENTS, BLOCK = 42, 32, 512
_EVEN = 0x5555555555555555


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; all words as one where there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(words) - n + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32_768):
        block = np.ascontiguousarray(hashes[at : at + 32_768]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def fingerprint(text: bytes, shingle: int) -> int:
    return majority(shingle_hashes(blank_words(text), shingle))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """_rid, doc_id and the fingerprint as a signed long, for rows of _rid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = [_signed(fingerprint(x, shingle)) for x in bytes_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["_rid", "doc_id", "fp"])

    return docs.select("_rid", "doc_id", "text").mapInArrow(run, "_rid long, doc_id long, fp long")


def image(fp: Column) -> Column:
    """Bit counts of the 2-bit segments in unary."""
    upper = F.shiftrightunsigned(fp, 1)
    even = F.lit(_EVEN)
    return fp.bitwiseOR(upper).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(even), 1))


def masks(distance: int, groups: int) -> list[int]:
    """The coordinates of each choice of groups - distance out of the groups of segments."""
    cut = [round(i * SEGMENTS / groups) for i in range(groups + 1)]
    part = [((1 << 2 * cut[i + 1]) - (1 << 2 * cut[i])) for i in range(groups)]
    return [_signed(sum(chosen)) for chosen in combinations(part, groups - distance)]


def bit_counts(x: np.ndarray) -> np.ndarray:
    """image() of many fingerprints."""
    up, low = (x >> np.uint64(1)) & np.uint64(_EVEN), x & np.uint64(_EVEN)
    return (low | up) | ((low & up) << np.uint64(1))


def linked(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether fingerprints are within distance: by the Manhattan distance of their bit counts, then by all bits."""
    out = np.bitwise_count(bit_counts(x) ^ bit_counts(y)) <= distance
    out[out] = np.bitwise_count((x ^ y)[out]) <= distance
    return out


def spanning(prints: np.ndarray, distance: int, part: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join parts: between prints left and right (places) within distance. part is updated."""
    edges = []
    for i in left.tolist():
        others = right[part[right] != part[i]]
        for j in others[linked(prints[others], np.broadcast_to(prints[i], len(others)), distance)].tolist():
            if part[j] != part[i]:
                edges.append((i, j))
                part[part == part[j]] = part[i]
    return edges


def _tested(distance: int):
    """Edges of block pairs: blocks i and j and how many there are, and rows of fingerprint, block and mark of being known."""

    def cell(i: int, j: int, blocks: int, prints: np.ndarray, block: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
        part = np.where(known, -1, np.arange(len(prints)))
        edges = []
        for own, other in ((i, j), (j, i)) if i != j else ((i, i),):
            mine = np.flatnonzero(block == own)
            inner = spanning(prints, distance, part, mine, mine)
            if other == (own + 1) % blocks or blocks == 1:
                edges += inner
        if i != j:
            edges += spanning(prints, distance, part, np.flatnonzero(block == i), np.flatnonzero(block == j))
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, blocks = (batch.column(c).to_pylist() for c in range(3))
            lists = batch.column(3)
            starts, rows = lists.offsets.to_numpy(), lists.values
            prints, block, known = rows.field(0).to_numpy().view(np.uint64), rows.field(1).to_numpy(), rows.field(2).to_numpy(zero_copy_only=False)
            found = [np.empty((2, 0), np.int64)]
            for k, (low, high) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                if edges := cell(i[k], j[k], blocks[k], prints[low:high], block[low:high], known[low:high]):
                    found.append(prints[low:high][np.array(edges).T].view(np.int64))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """Members of cells (id, blocks) with the two blocks, own and other, of each meeting."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A block meets every other one; where there is one block only, it meets itself.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 2, F.lit(0)))))
    return dealt.withColumn("other", F.when(F.col("blocks") == 1, 0).when(F.col("other") >= F.col("own"), F.col("other") + 1).otherwise(F.col("other")))


def grid_edges(prints: DataFrame, distance: int, groups: int) -> DataFrame:
    """Edges (a, b) that connect what is connected among fingerprints (id, distinct) of at most distance differing bits."""
    entries = prints.select("id", F.explode(cells_of(F.col("id"), distance, groups)).alias("cell"))
    shared = written(entries.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1"), "cells")
    # Shared cells grow with the data, so they are never broadcast.
    members = entries.join(shared.hint("merge"), "cell")
    counts = F.bit_count(image(F.col("id")).bitwiseXOR(image(F.col("hub"))))
    known = (counts <= distance) & (F.bit_count(F.col("id").bitwiseXOR(F.col("hub"))) <= distance)
    members = written(members.select("id", "cell", "hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), known.alias("known"), (F.col("n") > 2).alias("more")), "members")
    near = members.where("known and id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    # Two rows have met; in larger cells those that the smallest doesn't reach meet the others.
    rest = _dealt(members.where("more").select("id", "cell", "known", "blocks"))
    met = rest.groupBy("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "blocks").agg(F.collect_list(F.struct("id", "own", "known")).alias("rows"), F.bool_and("known").alias("done"))
    met = met.where("size(rows) > 1 and not done").select("i", "j", "blocks", "rows").mapInArrow(_tested(distance), "a long, b long")
    return near.union(met).distinct()


def cells_of(fp: Column, distance: int, groups: int) -> Column:
    """The cells of a fingerprint, hashed to one long each; a clash of hashes only adds a test."""
    seen = image(fp)
    return F.array(*[F.xxhash64(F.lit(k), seen.bitwiseAND(F.lit(m))) for k, m in enumerate(masks(distance, groups))])


def groups_for(prints: int, distance: int) -> int:
    """Coordinate groups with the fewest entries and chance pairs: a coordinate agrees by chance in 3 of 8 cases."""

    def cost(groups: int) -> float:
        agree = 0.375 ** (SEGMENTS * (groups - distance) / groups)
        return comb(groups, distance) * (1 + prints * agree / 2)

    return min(range(distance + 4, distance + 9), key=cost)


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, groups: int | None = None) -> DataFrame:
    """_rid, doc_id, fp and component_id (the smallest doc_id that links reach) for rows of _rid, doc_id, text."""
    prints = written(fingerprints(docs, shingle), "prints")
    nodes = written(prints.groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("first")), "nodes")
    edges = written(grid_edges(nodes, distance, groups or groups_for(nodes.count(), distance)), "links")
    roots = written(components(edges).select(F.col("node").alias("id"), "root"), "roots")
    rooted = written(nodes.join(roots, "id", "left").select("id", "first", F.coalesce("root", "id").alias("root")), "rooted")
    names = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = written(rooted.join(names, "root").select(F.col("id").alias("fp"), "component_id"), "named")
    return prints.join(named, "fp").select("_rid", "doc_id", "fp", "component_id")


# ---- Near copies by similarity: SimHash links and a prefix filter propose, the exact Jaccard decides.

PARITY = 8
_SLACK = 1e-9
#: Members of a cell beyond which its components first meet by their nearest pairs, which spares most of the others.
CROWDED = 32
#: Counters of shingles by hash: about this many for each row, as a power of two between these bounds (16 MB at most).
COUNTERS, LEAST_BITS, MOST_BITS, SLICES = 4, 16, 22, 16


def mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """Another hash of each value; bits are independent between the indices."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles in the order of their hashes."""
    return np.unique(shingle_hashes(blank_words(text), shingle))


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of least count, of which two sets of at least this Jaccard similarity share one at least.

    Any order of shingles that is the same for all sets will do; where frequent ones come last, few sets share a cell.
    """
    n, bits = len(shingles), len(counts).bit_length() - 1
    order = np.argsort(counts[(shingles >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
    return shingles[order[: n - int(np.ceil(n * similarity - _SLACK)) + 1]]


def parity(shingles: np.ndarray, size: int = 64 * PARITY) -> np.ndarray:
    """size bits as words; a bit tells whether an odd number of shingles falls on it, so two sets differ in no fewer shingles than bits."""
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_counts(texts: DataFrame, shingle: int, bits: int) -> np.ndarray:
    """In how many texts (text) the shingles of each hash beginning stand: one table of 2 ** bits counters per task, added up by slices."""
    width = (1 << bits) // SLICES

    def packed(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        blobs = [zlib.compress(x.tobytes(), 1) for x in counts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in small(batches):
            for text in bytes_of(batch.column(0)):
                np.add.at(counts, (shingle_set(text, shingle) >> np.uint64(64 - bits)).astype(np.int64), 1)
        yield packed({k: counts[k * width : (k + 1) * width] for k in range(SLICES)})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), np.uint32)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield packed(sums)

    rows = texts.select("text").mapInArrow(counted, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(added, "slice int, counts binary").collect()
    out = np.zeros(1 << bits, np.uint32)
    for k, blob in rows:
        out[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(blob), np.uint32)
    return out


_BITS = [f"p{i}" for i in range(PARITY)]
_SHAPE = ["n", *_BITS]


def _possible(similarity: float, x: str, y: str) -> Column:
    """False only where the parity bits rule the similarity out; columns of both sides by prefix."""
    bits = sum((F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in _BITS), F.lit(0))
    return bits <= (F.col(f"{x}n") + F.col(f"{y}n")) * ((1 - similarity) / (1 + similarity)) + _SLACK


def _sizes(similarity: float, one: str, two: str) -> Column:
    return F.least(one, two) >= F.greatest(one, two) * similarity - _SLACK


def _met(similarity: float, best: bool):
    """Pairs (a, b) of each list of rows (id, root, n, parity) that sizes and parity bits leave and that have different roots.

    best: of each two roots in a list only the pair of least distance.
    """
    slope = (1 - similarity) / (1 + similarity)

    def pairs(ids: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
        last, found = np.searchsorted(n, (n + _SLACK) / similarity, "right"), [np.empty((5, 0), np.int64)]
        for i in range(len(ids) - 1):
            at = np.arange(i + 1, last[i])
            at = at[root[at] != root[i]]
            if len(at):
                differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = differ <= (n[at] + n[i]) * slope + _SLACK
                at, x, r = at[near], ids[i], root[i]
                found.append(np.stack([np.minimum(root[at], r), np.maximum(root[at], r), differ[near], np.minimum(ids[at], x), np.maximum(ids[at], x)]))
        out = np.concatenate(found, axis=1)
        if best and out.shape[1]:
            out = out[:, np.lexsort(out[::-1])]
            out = out[:, np.append(True, (np.diff(out[:2]) != 0).any(axis=0))]
        return out[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            starts, x = lists.offsets.to_numpy(), lists.values
            every, roots, sizes = (x.field(i).to_numpy() for i in range(3))
            words = np.stack([x.field(3 + i).to_numpy().view(np.uint64) for i in range(PARITY)], axis=1)
            found = [np.empty((2, 0), np.int64)]
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                order = low + np.argsort(sizes[low:high], kind="stable")
                found.append(pairs(every[order], roots[order], sizes[order], words[order]))
            out = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    return run


def other_pairs(members: DataFrame, nodes: DataFrame, parts: DataFrame, similarity: float, best: bool) -> DataFrame:
    """Pairs (a, b) of members of a cell whose parts (id, root) have different roots; cells of one root need none."""
    rooted = written(members.select("id", "cell").join(parts, "id"), "rooted")
    open_cells = rooted.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_cells = written(open_cells.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cells")
    left = written(rooted.join(open_cells.hint("merge"), "cell"), "left")
    discard(rooted)
    dealt = _dealt(left.join(nodes.select("id", *_SHAPE), "id"))
    groups = dealt.groupBy("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("id", "root", *_SHAPE)).alias("rows"))
    out = written(groups.where("size(rows) > 1").select("rows").mapInArrow(_met(similarity, best), "a long, b long").distinct(), "met")
    discard(open_cells, left)
    return out


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (id, root) after links (a, b); a root is the smallest id that links reach."""
    for side in ("a", "b"):
        links = links.join(parts.select(F.col("id").alias(side), F.col("root").alias(f"{side}r")), side)
    ends = written(links.select(F.col("ar").alias("a"), F.col("br").alias("b")).where("a <> b").distinct(), "ends")
    higher = written(components(ends).select(F.col("node").alias("root"), F.col("root").alias("higher")), "higher")
    return written(parts.join(higher, "root", "left").select("id", F.coalesce("higher", "root").alias("root")), "parts")


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) have at least this Jaccard similarity of shingle sets (64-bit hashes).

    Parity bits, two to four for each shingle, rule most others out before whole sets move.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            hashes = [shingle_set(t, shingle) for t in bytes_of(batch.column(1))]
            wide = [parity(h, max(64, 1 << (2 * len(h) - 1).bit_length())).tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in hashes], pa.int64()), pa.array(wide, pa.binary()), pa.array([h.tobytes() for h in hashes], pa.binary())], names=["id", "n", "wide", "hashes"])

    def near(x: bytes, y: bytes, n: int) -> bool:
        one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        while len(one) != len(two):  # the longer one folded: hashes that differ in the upper bit alone fall together
            one, two = (one, two) if len(one) > len(two) else (two, one)
            one = one[: len(one) // 2] ^ one[len(one) // 2 :]
        return int(np.bitwise_count(one ^ two).sum(dtype=np.int64)) <= n * ((1 - similarity) / (1 + similarity)) + _SLACK

    def equal(x: bytes, y: bytes, n: int) -> bool:
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return both / (n - both) >= similarity

    def tested(left: DataFrame, column: str, test) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [test(x, y, n) for x, y, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        one = left.join(chosen.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col(column).alias("x")).hint("merge"), "a")
        two = one.join(chosen.select(F.col("id").alias("b"), "n", F.col(column).alias("y")).hint("merge"), "b")
        return written(two.select("a", "b", "x", "y", F.col("m") + F.col("n")).mapInArrow(run, "a long, b long"), "alike")

    wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    chosen = written(texts.join(wanted, "id", "left_semi").mapInArrow(sets, "id long, n long, wide binary, hashes binary"), "chosen")
    likely = tested(pairs, "wide", near)
    out = tested(likely, "hashes", equal)
    discard(wanted, chosen, likely)
    return out


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """docs with one row of each group of near copies: the smallest doc_id, of equal ones the first row.

    Rows are linked if the Jaccard similarity of their shingle sets is at least similarity; groups are what links reach.
    The first candidates are SimHash links of the shingles within distance, and each row with the smallest of every cell
    it shares. A cell is a shingle of least count; each pair of at least this similarity shares one, so none is missed
    when members of a cell that are in different components so far meet: in cells of very many first the two nearest of
    each two components, last all of them. Every link is verified on the sets.
    Texts without words stay.
    """
    key = unused(docs, "_rid")
    numbered = with_row_id(docs, key)
    plain = numbered.select(F.col(key).alias("rid"), "doc_id", "text")
    bits = min(MOST_BITS, max(LEAST_BITS, (COUNTERS * docs.count()).bit_length()))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(plain, shingle, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            every = [shingle_hashes(blank_words(t), shingle) for t in bytes_of(batch.column(2))]
            keep = pa.array([len(s) > 0 for s in every], pa.bool_())
            prints = pa.array([_signed(majority(s)) for s in every if len(s)], pa.int64())
            sets = [np.unique(s) for s in every if len(s)]
            same = [pa.array([int(mixed(s, i).sum().view(np.int64)) for s in sets], pa.int64()) for i in range(2)]
            words = np.array([parity(s) for s in sets], np.int64).reshape(-1, PARITY)
            cells = pa.array([prefix(s, counts.value, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), *same, prints, pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c) for c in words.T), cells], names=["rid", "doc_id", "k0", "k1", "fp", *_SHAPE, "cells"])

    prints = written(plain.mapInArrow(run, "rid long, doc_id long, k0 long, k1 long, fp long, " + ", ".join(f"{c} long" for c in _SHAPE) + ", cells array<long>"), "prints")
    # Equal sets (by size and two sums of hashes) are one node; its id is its first row.
    same = ["n", "k0", "k1"]
    heads = written(prints.groupBy(*same).agg(F.min("rid").alias("id")), "heads")
    nodes = written(prints.join(heads.select("id"), F.col("rid") == F.col("id"), "left_semi").select(F.col("rid").alias("id"), "fp", *_SHAPE, "cells"), "nodes")
    texts = plain.select(F.col("rid").alias("id"), "text")

    entries = nodes.select("id", F.col("n").cast("int").alias("n"), F.explode("cells").alias("cell"))
    shared = entries.groupBy("cell").agg(F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("hub")).where("m > 1").select("cell", "m", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = written(shared, "shared")
    members = written(entries.join(shared.hint("merge"), "cell"), "members")
    hubs = members.where((F.col("id") != F.col("hub")) & _sizes(similarity, "n", "hub_n")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    tried = hubs.union(_print_pairs(nodes, distance)).distinct()
    for side in ("a", "b"):
        tried = tried.join(nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}{c}") for c in _SHAPE]), side)
    tried = written(tried.where(_sizes(similarity, "an", "bn") & _possible(similarity, "a", "b")).select("a", "b"), "tried")
    parts = merged(written(nodes.select("id", F.col("id").alias("root")), "parts"), alike(tried, texts, shingle, similarity))
    for best in (True, False):
        met = members.where(F.col("m") > CROWDED) if best else members
        rest = written(other_pairs(met, nodes, parts, similarity, best).join(tried, ["a", "b"], "left_anti"), "rest")
        parts, tried = merged(parts, alike(rest, texts, shingle, similarity)), tried.union(rest)
    discard(members, nodes, shared)

    rooted = written(heads.join(parts, "id").select(*same, "root"), "rooted")
    rows = written(prints.select("rid", "doc_id", *same).join(rooted, same).select("rid", "doc_id", "root"), "rows")
    first = written(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("first")).select("first.rid"), "first")
    drop = rows.select("rid").join(first, "rid", "left_anti").select(F.col("rid").alias(key))
    return numbered.join(drop, key, "left_anti").select(docs.columns)


def _print_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes (id, fp), a < b, that SimHash links: equal fingerprints by their first node, others by the grid."""
    first = written(nodes.groupBy("fp").agg(F.min("id").alias("first")), "first")
    equal = nodes.join(first.hint("merge"), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    edges = written(grid_edges(first.select(F.col("fp").alias("id")), distance, groups_for(first.count(), distance)), "links")
    for side in ("a", "b"):
        edges = edges.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}1")), side)
    return equal.union(edges.select(F.least("a1", "b1").alias("a"), F.greatest("a1", "b1").alias("b")))
