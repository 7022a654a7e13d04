"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is cut into units at blanks and line ends, which a piece never crosses. The lattice of a unit has its byte
positions as nodes and vocabulary pieces as edges; a character that is no piece is spelt in byte pieces. The forward pass
adds up the weights of all ways to each node, once per distinct unit of a block; the backward pass draws an
incoming edge by its share of the node's sum, from the last node on, for all units of a block together. Of a unit
over LONG bytes only the sums are kept; its edges are found again, chunk by chunk, on the way back. Random numbers come
from a hash of the row key, the place of the unit and the step, so a row's tokens do not depend on where or how
often it is computed. A long text goes through in segments between units. Decoding joins the pieces' bytes and gives
back every text.

Piece weights are exp(theta * score) for unigram models; the scores of BPE models are ranks, for which the
weight is (rank + 1) ** -theta.

Defined cases: null and empty texts have no tokens; a literal U+2581 is spelt in bytes, so it isn't read back as a
blank; equal rows get equal tokens. An empty table gives no rows; a very long text goes through in segments; columns other than
doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of

MODEL, THETA, SEED = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 7
LONG, BLOCK_BYTES = 1 << 16, 1 << 20
_UNITS = re.compile(rb"\n| *[^ \n]+| +")
_SEAM = re.compile(rb"(?<=[^ \n])[ \n]")  # a unit ends before it
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Vocabulary of a model: id by surface bytes, surface bytes by id, weights, byte ids and a trie as a table."""

    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        scores = [model.get_score(i) for i in range(n)]
        ranks = any(x < -1000 for x in scores)
        self.ids, self.surface = {}, [b""] * n
        self.weight, self.bytes = np.zeros(n), np.zeros(256, np.int32)
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:-1], 16)
                self.bytes[value], self.surface[i] = i, bytes([value])
                self.weight[i] = -theta * math.log(n)
                continue
            self.surface[i] = text.replace("▁", " ").encode()
            self.ids[self.surface[i]] = i
            self.weight[i] = -theta * math.log(1 - scores[i]) if ranks else theta * scores[i]
        self.longest = max(map(len, self.ids))
        self._table()

    def _table(self) -> None:
        """next[state, class of byte] and the piece that ends in a state; -1 for none."""
        used = sorted({b for x in self.ids for b in x})
        self.classes = np.full(256, len(used), np.int64)
        self.classes[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        final = {}
        for text, i in self.ids.items():
            state = 0
            for c in text:
                if (x := children[state].get(c)) is None:
                    x = children[state][c] = len(children)
                    children.append({})
                state = x
            final[state] = i
        self.next = np.full((len(children), len(used) + 1), -1, np.int32)
        for state, below in enumerate(children):
            if below:
                self.next[state, self.classes[list(below)]] = list(below.values())
        self.final = np.full(len(children), -1, np.int32)
        self.final[list(final)] = list(final.values())

    def edges(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last and piece of every edge; left: bytes from each one to its unit's end."""
        return tuple(np.concatenate(x) for x in zip(*self.edges_by_size(data, left), strict=True))

    def edges_by_size(self, data: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The edges in parts, in which no two end at one byte."""
        live = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        classes, spelt = self.classes[data], np.ones(len(data), bool)
        spelt[(data & 0xC0) == 0x80] = False
        chars, state = live, np.zeros(len(live), np.int32)
        out = []
        for length in range(1, self.longest + 1):
            ok = left[live] >= length
            live, state = live[ok], state[ok]
            state = self.next[state, classes[live + length - 1]]
            ok = state >= 0
            live, state = live[ok], state[ok]
            if not len(live):
                break
            ids = self.final[state]
            hit = ids >= 0
            out.append((live[hit], live[hit] + length, ids[hit]))
            spelt[live[hit & (size[live] == length)]] = False
        for k in range(4):  # characters that are no piece, byte by byte
            at = chars[spelt[chars] & (size[chars] > k) & (left[chars] > k)] + k
            out.append((at, at + 1, self.bytes[data[at]]))
        return out

    def lattice(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward pass over all units together, place by place.

        First byte of each unit, number of the node after each byte, and for the incoming edges in the order of the
        nodes: source place, piece, and node number plus cumulative share.
        """
        data = np.frombuffer(b"".join(units), np.uint8)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        base = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(base, sizes)
        parts = self.edges_by_size(data, np.repeat(sizes, sizes) - place)
        # Edges are dealt to their nodes, which go by place (under LONG, so 16 bits sort in linear time), part by part.
        incoming = np.zeros(len(data), np.int64)
        for _, after, _ in parts:
            incoming[after - 1] += 1
        nodes = np.argsort(place.astype(np.uint16), kind="stable")
        nodes = nodes[incoming[nodes] > 0]
        counts = incoming[nodes]
        heads = np.cumsum(counts) - counts
        number = np.full(len(data), -1, np.int64)
        number[nodes] = np.arange(len(nodes))
        slot = np.zeros(len(data), np.int64)
        slot[nodes] = heads
        node = np.repeat(nodes, counts)
        first, ids = np.empty(len(node), np.int64), np.empty(len(node), np.int32)
        for begin, after, piece in parts:
            at = slot[after - 1]
            first[at], ids[at] = begin, piece
            slot[after - 1] = at + 1
        total, value = np.full(len(data), -np.inf), self.weight[ids]
        rounds = np.flatnonzero(np.diff(place[node[heads]], prepend=-1)) if len(heads) else np.empty(0, np.int64)
        for a, b in zip(rounds.tolist(), [*rounds[1:].tolist(), len(heads)], strict=True):
            low, high = heads[a], heads[b] if b < len(heads) else len(node)
            own = first[low:high]
            x = value[low:high] + np.where(place[own] > 0, total[own - 1], 0.0)
            cut = heads[a:b] - low
            top = np.maximum.reduceat(x, cut)
            total[node[heads[a:b]]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, counts[a:b])), cut))
            value[low:high] = x
        share = np.cumsum(np.exp(value - total[node]))
        before = np.concatenate(([0.0], share))[heads]
        ladder = share - np.repeat(before, counts)
        ladder = np.minimum(ladder, 1.0)
        ladder[heads + counts - 1] = 1.0
        return base, number, place[first], ids, np.repeat(np.arange(len(heads)), counts) + ladder

    def chunk(self, unit: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges that end in low + 1 .. high (characters begin at both): first byte, byte after the last, piece, by end."""
        start = max(0, low - self.longest)
        while start and unit[start] & 0xC0 == 0x80:
            start -= 1
        data = np.frombuffer(unit, np.uint8, high - start, start)
        first, after, ids = self.edges(data, np.arange(len(data), 0, -1))
        keep = np.flatnonzero(after + start > low)
        keep = keep[np.argsort(after[keep], kind="stable")]
        return first[keep] + start, after[keep] + start, ids[keep]

    def sampled_long(self, unit: bytes, state: int) -> np.ndarray:
        """Pieces of one long unit; state is what its random numbers are counted from."""
        cuts = [0]
        while cuts[-1] < len(unit):
            high = min(len(unit), cuts[-1] + LONG)
            while high < len(unit) and unit[high] & 0xC0 == 0x80:
                high -= 1
            cuts.append(high)
        total = np.full(len(unit) + 1, -np.inf)
        total[0] = 0.0
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            first, after, ids = self.chunk(unit, low, high)
            back = min(low, self.longest + 3)
            sums, weights = total[low - back : high + 1].tolist(), self.weight[ids].tolist()
            heads = np.flatnonzero(np.diff(after, prepend=-1)).tolist()
            first, ends = (first - low + back).tolist(), (after - low + back).tolist()
            for a, b in zip(heads, [*heads[1:], len(ends)], strict=True):
                ways = [sums[first[k]] + weights[k] for k in range(a, b)]
                top = max(ways)
                sums[ends[a]] = top + math.log(sum(math.exp(x - top) for x in ways)) if top > -math.inf else top
            total[low : high + 1] = sums[back:]
        out, at, step = [], len(unit), 0
        for low, high in zip(reversed(cuts[:-1]), reversed(cuts[1:]), strict=True):
            first, after, ids = self.chunk(unit, low, high)
            draws = _uniform(np.uint64(state) + np.arange(step + 1, step + 2 + high - low, dtype=np.uint64) * _GOLDEN)
            begun = step
            while at > low:
                a, b = np.searchsorted(after, (at, at + 1))
                ladder = np.cumsum(np.exp(total[first[a:b]] + self.weight[ids[a:b]] - total[at]))
                k = a + min(int(np.searchsorted(ladder, draws[step - begun], "right")), b - a - 1)
                out.append(ids[k])
                at, step = int(first[k]), step + 1
        return np.array(out[::-1], np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))


@cache
def pieces(path: str, theta: float) -> Pieces:
    return Pieces(path, theta)


def _uniform(state: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from mixed counters."""
    x = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sampled(texts: list[bytes], keys: list[int], vocabulary: Pieces, offsets: list[int] | None = None) -> list[np.ndarray]:
    """Token ids of each text; offsets: bytes before it, where it is a segment of a longer one."""
    split = [_UNITS.findall(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = list(chain.from_iterable(split))
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    if not len(lengths):
        return [np.empty(0, np.int32) for _ in texts]
    # Units count their random numbers from their place in the text, so no two count the same.
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(split)), sizes)
    head = begins[np.minimum(np.concatenate(([0], np.cumsum(sizes)))[:-1], len(begins) - 1)]
    place = begins - head[owner] + np.array(offsets or [0] * len(texts), np.int64)[owner]
    state = np.array(keys, np.uint64)[owner] + place.astype(np.uint64) * _GOLDEN
    index: dict[bytes, int] = defaultdict(count().__next__)
    fits = lengths <= LONG
    which = np.full(len(flat), -1, np.int64)
    which[fits] = np.fromiter(map(index.__getitem__, compress(flat, fits) if not fits.all() else flat), np.int64, int(fits.sum()))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    counts = np.zeros(len(which), np.int64)
    if index:
        base, number_of, source, ids, ladder = vocabulary.lattice(list(index))
        # Equal units side by side, so that their draws look at the same nodes.
        live = np.argsort(which.astype(np.int32), kind="stable")[len(which) - int(fits.sum()) :]
        at, step = lengths[live], 0
        while len(live):
            step += 1
            node = number_of[base[which[live]] + at - 1]
            edge = np.searchsorted(ladder, node + _uniform(state[live] + np.full(1, step, np.uint64) * _GOLDEN), "right")
            steps.append((live, ids[edge]))
            counts[live] += 1
            at = source[edge]
            go = at > 0
            live, at = live[go], at[go]
    long = {int(k): vocabulary.sampled_long(flat[k], int(state[k])) for k in np.flatnonzero(which < 0)}
    for k, drawn in long.items():
        counts[k] = len(drawn)
    stops = np.cumsum(counts)
    out = np.empty(int(stops[-1]), np.int32)
    for k, (who, drawn) in enumerate(steps):
        out[stops[who] - 1 - k] = drawn
    for k, drawn in long.items():
        out[stops[k] - len(drawn) : stops[k]] = drawn
    cuts = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(sizes)))]
    return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def segments(text: bytes, size: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of pieces of about size bytes or more that end between units."""
    at = 0
    while len(text) - at > size and (seam := _SEAM.search(text, at + size)):
        yield at, text[at : seam.start()]
        at = seam.start()
    yield at, text[at:]


def tokens_of(texts: list[bytes], keys: list[int], vocabulary: Pieces) -> list[np.ndarray]:
    """Token ids of each text, long ones by segments."""
    out = []
    for text, key in zip(texts, keys, strict=True):
        if len(text) > BLOCK_BYTES:
            out.append(np.concatenate([sampled([part], [key], vocabulary, [at])[0] for at, part in segments(text)]))
        else:
            out.append(None)
    short = [i for i, x in enumerate(out) if x is None]
    for i, x in zip(short, sampled([texts[i] for i in short], [keys[i] for i in short], vocabulary) if short else [], strict=True):
        out[i] = x
    return out


def row_key(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id), seed)


_ENCODED = "doc_id long, n_tokens long, tokens array<int>, lossless boolean"


def encoded(docs: DataFrame, model: str = MODEL, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """Sampled tokens of every row of docs (doc_id, text), and whether they decode to the text again."""

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
        ids, texts, held = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
            ids.append(doc)
            texts.append(text)
            held += len(text)
            if held >= BLOCK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model, theta)
        for batch in batches:
            for ids, texts in blocks(batch):
                rows = tokens_of(texts, [row_key(d, seed) for d in ids], vocabulary)
                whole = [vocabulary.decode(r.tolist()) == t for r, t in zip(rows, texts, strict=True)]
                cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(cuts).astype(np.int64)), tokens, pa.array(whole)], names=["doc_id", "n_tokens", "tokens", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, _ENCODED)


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for rows of doc_id and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model, THETA)
        for batch in batches:
            texts = [vocabulary.decode(x or []).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", F.col("tokens")).mapInArrow(run, "doc_id long, text string")
