"""Repeated byte strings by column-wise construction of the order of many texts' suffixes.

A byte goes if a string of SIZE bytes covers it that also starts earlier (smaller doc_id, or same row, earlier place).

Construction: texts are inserted one symbol each per round, from the last column to the first. A round sorts the
symbols of its column stably within the order so far, which gives the order of the suffixes that begin one column
earlier, and derives their common prefixes with their neighbours from the last ones: one more where the symbols are
equal and the minimum over the rows in between, else none. Columns are written to a file of the task and read back
one after another; in memory are only the order and the prefixes, of some neighbouring cores at a time. Neighbours that share SIZE symbols hold the same
string, and of each such class the earliest place is kept.

Whole texts would need as many rounds as the longest has bytes, and one order of all bytes. So what is inserted are pieces
of texts that can hold a repeat. Of the K-byte strings in each window of SIZE bytes the one with the smallest hash is
its anchor; equal windows have equal anchors at the same place. Anchors that occur once are dropped. The windows of an
anchor are cut into BANDS bands of starts, all windows of a band share its core of bytes, and pieces of equal core are
dealt to the same task with their columns aligned. Equal pieces are counted before that, so that a passage in very
many texts is one piece, and later ones of them are repeats as a whole.

Defined cases: null counts as empty; rows with the same doc_id are separate rows in the order in which they are read; a
null doc_id comes first; texts under SIZE bytes stay as they are.
An empty table gives no rows; a very long text is read in parts of a few MB; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, written

SIZE, K, BANDS = 100, 32, 3
SPAN = SIZE - K + 1  # starts of K-byte strings in a window
WIDE = -(-SPAN // BANDS)  # starts in a band
COLUMNS = WIDE + SIZE - 1
_CHUNK, _PIECE, _PAD = 1 << 17, 1 << 22, 255  # 255 is no byte of UTF-8
_LOWEST = -(1 << 63)
#: Different pieces of one core up to which they are ordered together; beyond, windows are compared one by one.
HOT = 4096
_BASE = 0x9E3779B97F4A7C15


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each K-byte string, doubled up from single bytes."""
    x, factor, have = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while have < K:
        x = x[:-have] * np.uint64(factor) + x[have:]
        factor, have = factor * factor & (1 << 64) - 1, 2 * have
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum over each n neighbours."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, anchor, first and last window start and anchor hash of each run of windows with one anchor."""
    part: list[tuple[int, int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - SIZE + 1, _PIECE):
            part.append((number, at, text[at : at + _PIECE + SIZE - 1]))
            held += len(part[-1][2])
            if held >= _CHUNK:
                yield _runs(part)
                part, held = [], 0
    if part:
        yield _runs(part)


def _runs(part: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(x for _, _, x in part), np.uint8)
    sizes = np.array([len(x) for _, _, x in part])
    begins = np.cumsum(sizes) - sizes
    hashes = _hashes(data)
    low = np.uint64((1 << 24) - 1)
    anchor = (_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), SPAN) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(part)), sizes)[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) <= (begins + sizes - SIZE)[owner])
    change = np.flatnonzero(np.diff(anchor[starts], prepend=-1))
    first, last = starts[change], starts[np.append(change[1:], len(starts)) - 1]
    who, a = owner[first], anchor[first]
    shift = np.array([at for _, at, _ in part])[who] - begins[who]
    return np.array([n for n, _, _ in part])[who], a + shift, first + shift, last + shift, hashes[a].view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids = np.array(batch.column(0).to_pylist(), np.int64)
        for who, anchor, _, _, h in runs(bytes_of(batch.column(1))):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rids[who]), pa.array(anchor.astype(np.int32))], names=["h", "rid", "at"])


def _listed(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[bytes], Iterator[tuple[int, int, int, int, int]]]]:
    """Row ids, ids and texts of a batch, and the runs whose anchors are listed: text, anchor, first, last, hash."""
    rids, docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))
    lists = batch.column(3)
    wanted = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(lists.offsets.to_numpy())) << 32 | lists.flatten().to_numpy().astype(np.int64))
    for who, anchor, first, last, h in runs(texts):
        place = who.astype(np.int64) << 32 | anchor
        use = wanted[np.minimum(np.searchsorted(wanted, place), len(wanted) - 1)] == place if len(wanted) else np.zeros(len(place), bool)
        yield rids, docs, texts, zip(*(x[use].tolist() for x in (who, anchor, first, last, h)), strict=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the listed anchors, with a hash of the run's bytes and of the anchor's place in it."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for rids, docs, texts, found in _listed(batch):
            out = [(h, _signed(digest(texts[k][s : e + SIZE], a - s)), docs[k], rids[k], a, s, e + 1) for k, a, s, e, h in found]
            if out:
                yield _batch(out, (pa.int64(),) * 4 + (pa.int32(),) * 3, ["h", "g", "doc", "rid", "at", "start", "stop"])


_OCCURRENCES = "h long, g long, doc long, rid long, at int, start int, stop int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the runs of the listed anchors: core hash, column of the first window, bytes and place."""
    types, names = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()), ["key", "column", "piece", "doc", "rid", "start"]
    for batch in batches:
        for rids, docs, texts, found in _listed(batch):
            out = []
            for k, a, s, e, _ in found:
                text = texts[k]
                for band in range((a - e) // WIDE, (a - s) // WIDE + 1):
                    core = a - band * WIDE  # the latest start of the band; windows of the band share what follows it
                    low = core - WIDE + 1
                    i, j = max(s, low), min(e, core)
                    out.append((_signed(xxhash.xxh64_intdigest(text[core : low + SIZE], band)), i - low, text[i : j + SIZE], docs[k], rids[k], i))
            if out:
                yield _batch(out, types, names)


_PIECES = "key long, column int, piece binary, doc long, rid long, start int"


class Columns:
    """Columns of pieces in a file of the task: rows come in blocks, columns go out one by one."""

    def __init__(self) -> None:
        self.file, self.blocks = tempfile.TemporaryFile(), []

    def add(self, pieces: list[bytes], column: np.ndarray) -> None:
        table = np.full((len(pieces), COLUMNS), _PAD, np.uint8)
        for row, piece, c in zip(table, pieces, column.tolist(), strict=True):
            row[c : c + len(piece)] = np.frombuffer(piece, np.uint8)
        self.blocks.append((self.file.tell(), len(pieces)))
        self.file.write(np.ascontiguousarray(table.T).tobytes())

    def column(self, c: int) -> np.ndarray:
        out = []
        for at, n in self.blocks:
            self.file.seek(at + c * n)
            out.append(np.frombuffer(self.file.read(n), np.uint8))
        return np.concatenate(out)


def _between(prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of prefix over low .. high (both included) for each pair, from a table of minima by powers of two."""
    out, length = np.empty(len(low), prefix.dtype), high - low + 1
    power, table, level = np.frexp(length)[1] - 1, prefix, 0
    while True:
        here = np.flatnonzero(power == level)
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << level) + 1])
        level += 1
        if level > (power.max() if len(power) else -1):
            return out
        half = 1 << level - 1
        table = np.minimum(table[:-half], table[half:])


def construct(columns, n: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds from the last column to the first: column, order of the rows' suffixes from there, common prefixes."""
    order, prefix = np.arange(n), np.zeros(n, np.int16)
    for c in range(width - 1, -1, -1):
        symbols = columns(c)[order]
        new = np.argsort(symbols, kind="stable")
        same = np.flatnonzero(symbols[new[1:]] == symbols[new[:-1]]) + 1
        after = np.zeros(n, np.int16)
        after[same] = 1 + _between(prefix, new[same - 1] + 1, new[same])
        order, prefix = order[new], after
        yield c, order, prefix


#: Pieces that are ordered together at least, if a task has so many; whole cores, which have HOT pieces at most.
TOGETHER = 100_000


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of pieces that have an earlier equal one: per piece, runs of window starts of its first place.

    Pieces come sorted by core; only those of some neighbouring cores are held at once.
    """
    store, parts, held, last = Columns(), [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        at = 0
        if held >= TOGETHER:
            change = np.flatnonzero(keys != np.append(last, keys[:-1]))
            if len(change):
                at = int(change[0])
                held += _add(store, parts, batch.slice(0, at))
                yield _repeated(store, parts)
                store, parts, held = Columns(), [], 0
        held += _add(store, parts, batch.slice(at))
        last = keys[-1]
    if parts:
        yield _repeated(store, parts)


def _add(store: Columns, parts: list, batch: pa.RecordBatch) -> int:
    if batch.num_rows:
        column = np.array(batch.column(1).to_pylist(), np.int64)
        pieces = batch.column(2).to_pylist()
        store.add(pieces, column)
        parts.append((column, np.array([len(p) for p in pieces]) - SIZE + 1, *(np.array(batch.column(c).to_pylist(), np.int64) for c in range(3, 6))))
    return batch.num_rows


def _repeated(store: Columns, parts: list) -> pa.RecordBatch:
    column, windows, doc, rid, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = len(column)
    rank = np.empty(n, np.int64)
    by = np.lexsort((rid, doc))
    rank[by] = np.cumsum(np.append(True, (np.diff(doc[by]) != 0) | (np.diff(rid[by]) != 0)))
    gone = np.zeros((WIDE, n), bool)
    top = np.iinfo(np.int64).max
    for c, order, prefix in construct(store.column, n, COLUMNS):
        if c >= WIDE:
            continue
        heads = np.flatnonzero(prefix < SIZE)
        heads = heads if len(heads) and heads[0] == 0 else np.append(0, heads)
        valid = ((column <= c) & (c < column + windows))[order]
        place = np.where(valid, (rank << 32 | start + (c - column))[order], top)
        least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, n)))
        gone[c, order] = valid & (place > least)
    store.file.close()
    some = np.flatnonzero(gone.any(axis=0))
    edge = np.diff(np.pad(gone[:, some].astype(np.int8), ((1, 1), (0, 0))), axis=0)
    who, at = np.nonzero(edge.T == 1)
    _, to = np.nonzero(edge.T == -1)
    base = (start - column)[some][who]
    return pa.RecordBatch.from_arrays([pa.array(rid[some][who]), pa.array((base + at).astype(np.int32)), pa.array((base + to).astype(np.int32))], names=["rid", "start", "stop"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes under covered windows; starts and stops are of windows, the stop excluded."""
    for batch in batches:
        out = []
        for rid, text, spans in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((x["start"], x["stop"] + SIZE - 1) for x in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            at, digest = 0, hashlib.sha256()
            for a, b in merged:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((rid, sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [x for m in merged for x in m]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["rid", "n_removed", "n_spans", "kept_sha256", "spans"])


def _single_windows(contents: DataFrame) -> DataFrame:
    """Windows that occur earlier, for cores with too many different pieces for one task: each window by itself.

    Windows are compared by two 64-bit hashes; the minimum is partial before the shuffle and stored before it is joined.
    """
    each = contents.select("doc", "rid", "start", "piece", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - SIZE)).alias("i"))
    body = F.substring(F.col("piece"), F.col("i") + 1, F.lit(SIZE))
    each = each.select("doc", "rid", (F.col("start") + F.col("i")).alias("at"), F.xxhash64(body).alias("w1"), F.xxhash64(F.lit(1), body).alias("w2"))
    first = each.groupBy("w1", "w2").agg(F.min(F.struct("doc", "rid", "at")).alias("x")).select("w1", "w2", F.col("x.rid").alias("first_rid"), F.col("x.at").alias("first_at"))
    again = each.join(written(first, "windows"), ["w1", "w2"]).where("rid <> first_rid or at <> first_at")
    return again.select("rid", F.col("at").alias("start"), (F.col("at") + 1).alias("stop"))


def repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs (_rid, doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end, ... in bytes).

    Whole copies of a text are settled by their SHA-256 first: but for the earliest row, all their bytes go.
    """
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.col("_rid").alias("rid"), "doc_id", F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    keys = written(whole, "keys")
    first = written(keys.groupBy("sha", "n_bytes").agg(F.min(F.struct("doc", "rid")).alias("x")).select("x.rid", "x.doc"), "first")
    anchors = written(docs.select("_rid", "text").mapInArrow(_anchors, "h long, rid long, at int"), "places")
    again = written(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    places = anchors.join(again, "h").groupBy("rid").agg(F.collect_list("at").alias("at")).join(first, "rid")
    texts = docs.select(F.col("_rid").alias("rid"), "text").join(places, "rid").select("rid", "doc", "text", "at")
    texts = written(texts, "texts")
    discard(anchors)
    found = written(texts.mapInArrow(_occurrences, _OCCURRENCES), "occurrences")
    groups = found.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.min(F.struct("doc", "rid", "start")).alias("x"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("h", (F.col("low") != F.col("high")).alias("mixed"), F.col("x.rid").alias("first_rid"), F.col("x.start").alias("first_start")), "groups")
    later = F.col("mixed") | (F.col("rid") != F.col("first_rid")) | (F.col("start") != F.col("first_start"))
    marks = found.join(groups, "h").where(later).groupBy("rid").agg(F.collect_list(F.when(F.col("mixed"), F.col("at"))).alias("at"), F.collect_list(F.when(~F.col("mixed"), F.struct("start", "stop"))).alias("covered"))
    marked = written(texts.drop("at").join(marks, "rid").select("rid", "doc", "text", "at", "covered"), "marked")
    discard(again, texts, groups, found)
    texts = marked
    pieces = texts.where("size(at) > 0").select("rid", "doc", "text", "at").mapInArrow(_pieces, _PIECES)
    contents = pieces.groupBy("key", "column", "piece").agg(F.min(F.struct("doc", "rid", "start")).alias("first"), F.count("*").alias("n"))
    names = [F.xxhash64("key", "column", "piece").alias("g1"), F.xxhash64(F.lit(1), "piece", "column", "key").alias("g2")]
    contents = written(contents.select("key", *names, "column", "piece", "first.doc", "first.rid", "first.start", "n"), "contents")
    hot = written(contents.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select("key"), "hot")
    cold = contents.join(hot, "key", "left_anti")
    inner = cold.repartition("key").sortWithinPartitions("key").select("key", "column", "piece", "doc", "rid", "start").mapInArrow(_classes, "rid long, start int, stop int")
    inner = inner.union(_single_windows(contents.join(hot, "key", "left_semi")))
    many = written(contents.where("n > 1").select("g1", "g2", F.col("rid").alias("first_rid"), F.col("start").alias("first_start")), "many")
    copies = pieces.select(*names, "rid", "start", (F.col("start") + F.octet_length("piece") - (SIZE - 1)).alias("stop")).join(many, ["g1", "g2"])
    copies = copies.where("rid <> first_rid or start <> first_start").select("rid", "start", "stop")
    more = inner.union(copies).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    covered = texts.select("rid", "text", "covered").join(more, "rid", "left").select("rid", "text", F.concat("covered", F.coalesce("more", none)).alias("covered"))
    kept = covered.where("size(covered) > 0").mapInArrow(_kept, "rid long, n_removed long, n_spans long, kept_sha256 string, spans array<int>")
    kept = written(kept, "kept")
    discard(texts, contents, many)
    rows = keys.join(first.select("rid", F.lit(True).alias("is_first")), "rid", "left").join(kept, "rid", "left")
    copy = F.col("is_first").isNull() & (F.col("n_bytes") >= SIZE)
    return rows.select(
        F.col("rid").alias("_rid"),
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0), F.col("n_bytes").cast("int"))).otherwise(F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"),
    )
