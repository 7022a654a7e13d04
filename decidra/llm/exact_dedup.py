"""Exact duplicates owned by the terminal nodes of compressed radix tries.

Each task puts its texts into a Patricia trie, so that of a text that occurs many times in a task one copy
goes on. These copies are dealt by length and content hash, and the trie of each partition compares whole byte
strings. A terminal node keeps the smallest (or largest) identifier and the number of rows. A trie that outgrows
its memory writes its largest subtree to a file of the task and finishes it later by itself. A text that very many
tasks hold goes through tries of fewer tasks first, so that no task gets a copy of it from each.

Defined cases: a null text counts as empty; empty texts are equal to each other; of rows with the same doc_id the
one read later counts as larger; a null doc_id counts as smallest; an empty table gives an empty table.
A very long text is one key of a trie, which spills; other columns are not read by the query, and drop_copies returns them.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, unused, with_row_id, written

TRIE_BYTES = 48 << 20
#: Copies of one size and hash, one from each task, up to which they go to one task; more are dealt to this many first.
COPIES = 64
#: Sizes and hashes of more copies that are sent to all executors; beyond, they are joined by a shuffle.
HOT = 100_000
_LOWEST = -(1 << 63)


class PatriciaTrie:
    """Compressed radix trie over byte strings; a node is [edge label, children by first byte, value]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.held = 0

    def terminal(self, key: bytes) -> list:
        """The node at which key ends, made where there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.held += len(key) - at + 200
                return child
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)
            while low < high:  # the longest common part; the first byte is the same
                mid = (low + high + 1) // 2
                low, high = (mid, high) if key.startswith(label[:mid], at) else (low, mid - 1)
            upper = [label[:low], {label[low]: child}, None]
            child[0] = label[low:]
            node[1][key[at]] = upper
            self.held += 200
            node, at = upper, at + low
        return node

    def cut(self, first: int) -> Iterator[tuple[bytes, object]]:
        """Takes the subtree below the root's edge that begins with this byte out of the trie."""
        yield from self._walk(self.root[1].pop(first), b"")

    def items(self) -> Iterator[tuple[bytes, object]]:
        yield from self._walk(self.root, b"")

    @staticmethod
    def _walk(top: list, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[2] is not None:
                yield key, node[2]
            stack.extend((x, key) for x in node[1].values())


class Owners:
    """Groups of equal strings: owner, number of rows and the numbers of the partial groups."""

    def __init__(self, larger: bool, limit: int = TRIE_BYTES, skip: int = 0) -> None:
        self.larger, self.limit, self.skip = larger, limit, skip  # skip: leading bytes that all keys share
        self.trie, self.files, self.sizes = PatriciaTrie(), {}, {}

    def add(self, key: bytes, owner: tuple[int, int], rows: int, parts: list[int]) -> None:
        tail = key[self.skip :]
        if tail and (spilled := self.files.get(tail[0])):
            self._store(spilled, key, owner, rows, parts)
            return
        before = self.trie.held
        node = self.trie.terminal(tail)
        if (x := node[2]) is None:
            node[2] = [owner, rows, list(parts)]
        else:
            x[0] = max(x[0], owner) if self.larger else min(x[0], owner)
            x[1] += rows
            x[2] += parts
        if tail:
            self.sizes[tail[0]] = self.sizes.get(tail[0], 0) + self.trie.held - before
        if self.trie.held > self.limit and tail:
            self._spill(key[: self.skip])

    def _spill(self, prefix: bytes) -> None:
        first = max(self.sizes, key=self.sizes.get)
        self.files[first] = spilled = [tempfile.TemporaryFile(), None]
        for tail, (owner, rows, parts) in self.trie.cut(first):
            self._store(spilled, prefix + tail, owner, rows, parts)
        self.trie.held -= self.sizes.pop(first)

    @staticmethod
    def _store(spilled: list, key: bytes, owner: tuple[int, int], rows: int, parts: list[int]) -> None:
        shared = spilled[1]
        spilled[1] = key if shared is None else os.path.commonprefix([shared, key])
        spilled[0].write(struct.pack(f"<qqqqq{len(parts)}q", len(key), *owner, rows, len(parts), *parts) + key)

    def results(self, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple[int, int], int, list[int]]]:
        """String, owner, number of rows and parts; prefix: the skipped bytes."""
        for tail, value in self.trie.items():
            yield prefix + tail, *value
        self.trie = PatriciaTrie()
        for file, shared in self.files.values():
            below = Owners(self.larger, self.limit, len(shared))
            file.seek(0)
            while head := file.read(40):
                size, *owner, rows, n = struct.unpack("<qqqqq", head)
                parts = list(struct.unpack(f"<{n}q", file.read(8 * n)))
                below.add(file.read(size), tuple(owner), rows, parts)
            file.close()
            yield from below.results(shared)


_LOCAL = "rid long, doc_id long, part long, sha string, owner long, owner_rid long, n long, size long, hash long, body binary"


def _local(larger: bool, limit: int):
    """Rows of two kinds: one per document with the number of its group in this task, one per group with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("sha", pa.string()), ("owner", pa.int64()), ("owner_rid", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("hash", pa.int64()), ("body", pa.binary())])
        part, trie = TaskContext.get().partitionId() << 33, PatriciaTrie()

        def groups() -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for key, (number, owner, n, digest) in trie.items():
                rows.append((None, None, number, None, *owner, n, len(key), struct.unpack("<q", digest[:8])[0], key))
                held += len(key)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            rids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts, shas = [], []
            for rid, doc, text in zip(rids, ids, bytes_of(batch.column(2)), strict=True):
                key, owner = text.translate(LOWER), (_LOWEST if doc is None else doc, rid)
                node = trie.terminal(key)
                if (x := node[2]) is None:
                    node[2] = x = [part, owner, 0, hashlib.sha256(key).digest()]
                    part += 1
                x[1] = max(x[1], owner) if larger else min(x[1], owner)
                x[2] += 1
                parts.append(x[0])
                shas.append(x[3].hex())
                if trie.held > limit:
                    yield from groups()
                    trie = PatriciaTrie()
            none = pa.nulls(len(rids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(shas, pa.string()), none, none, none, none, none, pa.nulls(len(rids), pa.binary())], schema=schema)
        yield from groups()

    return run


def _long_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("part", "keep_id", "keep_rid", "group_size")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _merged(larger: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = Owners(larger, limit)
        for batch in batches:
            for part, owner, rid, n, key in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                owners.add(key, (owner, rid), n, [part])
        out: list[tuple] = []
        for _, (owner, rid), n, parts in owners.results():
            out += [(p, None if owner == _LOWEST else owner, rid, n) for p in parts]
            if len(out) >= 50_000:
                yield _long_batch(out)
                out = []
        if out:
            yield _long_batch(out)

    return run


_REGROUPED = "part long, into long, owner long, owner_rid long, n long, size long, hash long, body binary"


def _regrouped(larger: bool, limit: int):
    """Rows of two kinds: the new number of each part, and one group with its text for each new number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = Owners(larger, limit)
        names = [x.split()[0] for x in _REGROUPED.split(", ")]
        for batch in batches:
            for part, owner, rid, n, key in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                owners.add(key, (owner, rid), n, [part])
        for key, owner, n, parts in owners.results():
            into = min(parts)
            rows = [(p, into, None, None, None, None, None, None) for p in parts]
            rows.append((None, into, *owner, n, len(key), struct.unpack("<q", hashlib.sha256(key).digest()[:8])[0], key))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "body" else pa.int64()) for name, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return run


def exact_owners(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES, copies: int = COPIES) -> DataFrame:
    """One row per row of docs (_rid, doc_id, text): the row of its group of equal texts that stays.

    Texts are equal when identical after lower-casing A-Z. Columns: _rid, doc_id, keep_id, keep_rid, group_size,
    kept, text_sha256. Text is dealt once, and only one copy of it per task; twice where more than `copies` tasks hold it.
    """
    larger = {"smallest": False, "largest": True}[keep]
    local = written(docs.select("_rid", "doc_id", "text").mapInArrow(_local(larger, trie_bytes), _LOCAL), "exact")
    groups = local.where("body is not null").select("part", "owner", "owner_rid", "n", "body", "size", "hash")
    hot = written(groups.groupBy("size", "hash").agg(F.count("*").alias("copies")).where(F.col("copies") > copies).select("size", "hash"), "hot")
    few = hot.count()
    again = None
    if few:
        known = F.broadcast(hot) if few <= HOT else hot.hint("merge")
        dealt = groups.join(known, ["size", "hash"], "left_semi").repartition("size", "hash", F.pmod(F.xxhash64("part"), F.lit(copies)))
        again = written(dealt.select("part", "owner", "owner_rid", "n", "body").mapInArrow(_regrouped(larger, trie_bytes), _REGROUPED), "regrouped")
        fewer = again.where("body is not null").select(F.col("into").alias("part"), "owner", "owner_rid", "n", "body", "size", "hash")
        groups = groups.join(known, ["size", "hash"], "left_anti").select(*fewer.columns).union(fewer)
    groups = groups.repartition("size", "hash").select("part", "owner", "owner_rid", "n", "body")
    merged = groups.mapInArrow(_merged(larger, trie_bytes), "part long, keep_id long, keep_rid long, group_size long")
    rows = local.where("body is null").select(F.col("rid").alias("_rid"), "doc_id", "part", F.col("sha").alias("text_sha256"))
    if again is not None:
        into = again.where("body is null").select("part", "into")
        rows = rows.join(into, "part", "left").withColumn("part", F.coalesce("into", "part"))
    return rows.join(merged, "part").select("_rid", "doc_id", "keep_id", "keep_rid", "group_size", (F.col("_rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs without the rows whose text another row owns; columns as before."""
    key = unused(docs, "_rid")
    numbered = with_row_id(docs, key)
    stay = exact_owners(numbered.select(F.col(key).alias("_rid"), "doc_id", "text"), keep).where("kept")
    return numbered.join(stay.select(F.col("_rid").alias(key)), key, "left_semi").select(docs.columns)
