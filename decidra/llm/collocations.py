"""Collocations: phrases of up to DEPTH words by count tries, with the score of their weakest cut.

Each task keeps its shard of the texts as a trie of counts, DEPTH words deep: a sorted array of codes that hold a word number
for each level, so that a node's subtree stands behind it. A trie of LIMIT nodes is serialised in the order of its words and a
new one begun. It goes out in pieces, one for each range of prefixes that it meets; a range's task reads the pieces of all
shards in order of their first prefix, merges them and passes on what no later piece can change, so it holds no more
than the pieces that overlap. Walking a merged range gives each node the counts of its ancestors, which are the left parts of its
cuts. Right parts are where suffix links lead: they are joined by their words, as are the ancestors of the nodes at
the head of a range, which may stand in the one before.

Only nodes that occur often enough leave the merge: the parts of a phrase are at least as frequent as it is. Cuts of the
ranges come from a bounded sample of the texts; they decide which task counts what, and no count.

Defined cases: null and empty texts have no words; a null language is `und`; a word is what stands between blanks and
tabs, so other control characters belong to words; a very long text is read in parts that overlap by DEPTH - 1 words, a very
long word stays whole; repeated rows count each time; an empty table has no phrases; other columns are not read, so
names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, written

DEPTH, LEAST, CONTAINED, TOP = 3, 10, 50, 2000
#: Nodes of a shard's trie, of a serialised piece, of a merge and of a range; word numbers of a trie; bytes that are read at once.
LIMIT, PIECE, HELD, RANGE, WORDS, CHUNK = 1_500_000, 1 << 15, 1_000_000, 1_000_000, 600_000, 1 << 21
#: Documents that the cuts of the ranges are taken from, and nodes for each key that comes to the driver.
SAMPLE, STEP = 4000, 128
BITS = 21
_END = b"\xff"  # no byte of UTF-8; stands for the end of a piece of text
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_SHIFTS = [BITS * (DEPTH - 1 - k) for k in range(DEPTH)]
_PIECES = "range long, lang string, n long, first array<binary>, size long, data binary"


class Numbers(dict):
    """Words in order of appearance, from 1 on; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def spans(data: bytes, size: int = 0) -> Iterator[tuple[bytes, bool]]:
    """Parts of about size bytes that end at a piece's end or before a blank, and whether the piece goes on behind them."""
    begin, size = 0, size or CHUNK
    while len(data) - begin > size:
        cut = data.rfind(_END, begin, begin + size)
        if cut < 0:
            cut = data.rfind(b" ", begin, begin + size)
        if cut <= begin:
            found = [x for x in (data.find(_END, begin + 1), data.find(b" ", begin + 1)) if x > 0]
            cut = min(found, default=len(data))
        yield data[begin:cut], data[cut : cut + 1] == b" "
        begin = cut + 1
    yield data[begin:], False


def grams(numbers: np.ndarray, known: int) -> np.ndarray:
    """Codes of all sequences of up to DEPTH words that end behind the known words at the head."""
    out = []
    for n in range(1, DEPTH + 1):
        count = len(numbers) - n + 1
        if count <= 0:
            break
        code, whole = np.zeros(count, np.int64), np.ones(count, bool)
        for k in range(n):
            word = numbers[k : k + count]
            code |= word << _SHIFTS[k]
            whole &= word > 0
        whole[: max(0, known - n + 1)] = False
        out.append(code[whole])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of codes and counts as one; a stable sort merges runs that are in order."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts


class Shard:
    """Tries of a shard, one for each language, over one numbering of words."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.nodes = Numbers(), defaultdict(list), 0

    def add(self, lang: str, data: bytes) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """Adds texts whose pieces are parted by _END; gives tries that are full."""
        context: list[bytes] = []
        for part, on in spans(data.translate(_TABLE)):
            tokens = part.replace(_END, b" \xff ").split()
            numbers = np.fromiter((self.numbers[w] for w in context), np.int64, len(context))
            own = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
            if words := np.count_nonzero(own):
                codes, counts = np.unique(grams(np.concatenate((numbers, own)), len(context)), return_counts=True)
                self.parts[lang].append((np.append(0, codes), np.append(words, counts)))
                self.nodes += len(codes) + 1
            if self.nodes > LIMIT and self.merged() > LIMIT // 2 or len(self.numbers) > WORDS:
                yield from self.flushed()
            recent = (tokens if len(tokens) >= DEPTH - 1 else [*context, *tokens])[1 - DEPTH :] if on else []
            context = recent[max((k + 1 for k, w in enumerate(recent) if w == _END), default=0) :]

    def merged(self) -> int:
        for lang, parts in self.parts.items():
            self.parts[lang] = [summed(parts)]
        self.nodes = sum(len(p[0][0]) for p in self.parts.values())
        return self.nodes

    def flushed(self) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """(language, its sorted words, codes by their places from 1 on, counts), and the shard is empty again."""
        words = list(self.numbers)
        order = sorted(range(1, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), np.int64)
        rank[order] = np.arange(1, len(words))
        ranked = [words[k] for k in order]
        for lang, parts in self.parts.items():
            codes, counts = summed(parts)
            codes = recoded(codes, rank)
            by = np.argsort(codes)
            yield lang, ranked, codes[by], counts[by]
        self.numbers, self.parts, self.nodes = Numbers(), defaultdict(list), 0


def recoded(codes: np.ndarray, number: np.ndarray) -> np.ndarray:
    out, low = np.zeros(len(codes), np.int64), (1 << BITS) - 1
    for s in _SHIFTS:
        out |= number[(codes >> s) & low] << s
    return out


def key(code: int, words: list[bytes]) -> list[bytes]:
    """The words of a code."""
    return [words[x - 1] for x in ((code >> s) & ((1 << BITS) - 1) for s in _SHIFTS) if x]


def lowest(cut: tuple, words: list[bytes]) -> int:
    """The smallest code of these words that is not below the cut."""
    code = 0
    for w, s in zip(cut, _SHIFTS, strict=False):
        at = bisect_left(words, w)
        code |= at + 1 << s
        if at == len(words) or words[at] != w:
            break
    return code


def packed(codes: np.ndarray, counts: np.ndarray, words: list[bytes]) -> bytes:
    """Codes, counts and the words they use, in order."""
    low = (1 << BITS) - 1
    levels = [(codes >> s) & low for s in _SHIFTS]
    used = np.unique(np.concatenate(levels))
    used = used[used > 0]
    text = b" ".join([words[k - 1] for k in used.tolist()])
    number = np.append(0, used)
    columns = [np.searchsorted(number, x).astype("<u4").tobytes() for x in levels]
    return b"".join([np.array([len(codes), len(text)], "<i8").tobytes(), counts.astype("<i8").tobytes(), *columns, text])


def unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    n, length = np.frombuffer(data, "<i8", 2).tolist()
    counts = np.frombuffer(data, "<i8", n, 16).astype(np.int64)
    codes = np.zeros(n, np.int64)
    for k, s in enumerate(_SHIFTS):
        codes |= np.frombuffer(data, "<u4", n, 16 + 8 * n + 4 * n * k).astype(np.int64) << s
    text = data[16 + 8 * n + 4 * n * DEPTH :][:length]
    return text.split(b" ") if text else [], codes, counts


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    texts = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
        texts[lang].append(text)
    for lang, own in texts.items():
        yield lang, _END.join(own)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    shard = Shard()
    for batch in batches:
        for lang, data in _by_language(batch):
            yield from shard.add(lang, data)
    yield from shard.flushed()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every STEP-th node of the sample's tries."""
    for lang, words, codes, _ in _tries(batches):
        keys = [[lang.encode(), *key(c, words)] for c in codes[STEP // 2 :: STEP].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.binary())), pa.array([len(codes)] + [0] * (len(keys) - 1) if keys else [], pa.int64())], names=["key", "n"])


def cuts(docs: DataFrame) -> list[tuple]:
    """Prefixes at which ranges of about RANGE nodes begin, one range for each shuffle partition at least."""
    rows, most = docs.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = docs.sample(min(1.0, SAMPLE / max(1, rows)), 7) if rows > SAMPLE else docs
    found = some.mapInArrow(_sampled, "key array<binary>, n long").collect()
    nodes = len(found) * STEP * max(1.0, rows / SAMPLE)
    n = max(most, int(nodes / RANGE))
    keys = sorted({tuple(bytes(w) for w in r["key"]) for r in found})
    return sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []


def _dealt(at: list[tuple]):
    """Pieces of the shards' tries, cut where ranges begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes, counts in _tries(batches):
            name = lang.encode()
            before = bisect_left(at, (name,))
            own = at[before : bisect_left(at, (name + b"\0",))]
            edges = [0, *np.searchsorted(codes, [lowest(x[1:], words) for x in own]).tolist(), len(codes)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                for i in range(a, b, PIECE):
                    j = min(b, i + PIECE)
                    data = packed(codes[i:j], counts[i:j], words)
                    small = pa.compress(data, codec="zstd", asbytes=True)
                    row = [before + k], [lang], [j - i], [key(int(codes[i]), words)], [len(data)], [small]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.binary()), strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


class Merge:
    """Pieces of one range and language in order of their first prefix; nodes come out in order, with the counts above them."""

    def __init__(self, lang: str, least: int) -> None:
        self.lang, self.least, self.held, self.nodes, self.above = lang, least, [], 0, []

    def add(self, data: bytes) -> Iterator[pa.RecordBatch]:
        piece = unpacked(data)
        self.held.append(piece)
        self.nodes += len(piece[1])
        if self.nodes > HELD:
            yield from self.out(key(int(piece[1][0]), piece[0]))

    def out(self, before: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
        """Nodes before this prefix, or all."""
        words = sorted(set().union(*(p[0] for p in self.held)))
        place = {w: k for k, w in enumerate(words, 1)}
        parts = []
        for own, codes, counts in self.held:
            number = np.fromiter((0, *(place[w] for w in own)), np.int64, len(own) + 1)
            parts.append((recoded(codes, number), counts))
        codes, counts = summed(parts)
        end = len(codes) if before is None else int(np.searchsorted(codes, lowest(tuple(before), words)))
        self.held, self.nodes = [], 0
        if end < len(codes):
            self.held, self.nodes = [unpacked(packed(codes[end:], counts[end:], words))], len(codes) - end
        if end:
            yield from self.named(codes[:end], counts[:end], words)

    def named(self, codes: np.ndarray, counts: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        often = np.flatnonzero((counts >= self.least) | (codes == 0))
        rows = []
        for code, n in zip(codes[often].tolist(), counts[often].tolist(), strict=True):
            path = key(code, words)
            ways = [b" ".join(path[:k]) for k in range(1, len(path) + 1)]
            lefts = [x[1] if x[0] == w else None for x, w in zip_longest(self.above[: len(ways) - 1], ways[:-1], fillvalue=(None, None))]
            if path:
                self.above = [*self.above, *[(None, None)] * len(path)][: len(path) - 1] + [(ways[-1], n)]
            rows.append((self.lang, len(path), ways[-1] if path else b"", n, lefts))
        if rows:
            types = (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["lang", "depth", "phrase", "a", "lefts"])


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merge = None, None
        for batch in batches:
            for r, lang, size, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5)), strict=True):
                if now != (r, lang):
                    if merge:
                        yield from merge.out()
                    now, merge = (r, lang), Merge(lang, least)
                yield from merge.add(pa.decompress(data, size, codec="zstd", asbytes=True))
        if merge:
            yield from merge.out()

    return run


def nodes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, depth, phrase, a, lefts): sequences of up to DEPTH words that occur at least so often, and each language's root.

    lefts are the counts of the first words, as far as they stand in the same range.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    at = cuts(rows)
    pieces = rows.mapInArrow(_dealt(at), _PIECES).repartitionById(len(at) + 1, F.col("range").cast("int"))
    merged = pieces.sortWithinPartitions("range", "lang", "first").mapInArrow(_merged(least), "lang string, depth int, phrase binary, a long, lefts array<long>")
    return merged.withColumn("phrase", F.col("phrase").cast("string"))


def collocations(docs: DataFrame, least: int = LEAST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """The first phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase that stands inside a longer one which occurs at least `contained` percent as often is left out.
    """
    every = written(nodes(docs, least), "nodes")
    words = F.split("phrase", " ")
    phrases = every.where("depth > 1")
    side = lambda k, left, part, f: F.struct(k.alias("k"), F.lit(left).alias("left"), F.array_join(part, " ").alias("part"), f.alias("f"))
    sides = lambda k: F.array(side(k, True, F.slice(words, 1, k), F.get("lefts", k - 1)), side(k, False, F.slice(words, k + 1, F.col("depth")), F.lit(None).cast("long")))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("depth") - 1), sides))
    each = phrases.select("lang", "phrase", "a", F.explode(parts).alias("x")).select("lang", "phrase", "a", "x.*")
    found = each.where("f is null").drop("f").join(every.where("depth > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    both = each.where("f is not null").drop("part").unionByName(found.drop("part"))
    cut = both.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r"))
    weakest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    shorter = lambda n: F.transform(F.sequence(F.lit(1), F.col("depth") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    inside = every.where("depth > 2").select("lang", F.col("a").alias("of"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("depth") - 1), shorter))).alias("phrase"))
    longer = written(inside.groupBy("lang", "phrase").agg(F.max("of").alias("of")), "longer")
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("of") < contained * F.col("a"), F.lit(True))).drop("of")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = every.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
