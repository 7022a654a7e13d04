"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training uses a bounded sample of labelled documents (SAMPLE of each class by hash of the id, at most SAMPLE_BYTES of
text in that order). Candidates for features are words and beginnings of words that stand in many unlike toxic documents
of it (near copies share minimal shingle hashes and count as one). They are counted in all labelled documents outside
the held-out third, and those stay whose share in toxic ones is higher beyond chance. They mark tokens, whose labels
are those of the document; a chain of two states is fitted to labelled windows, with weights for a marked token's own
feature, for frequent words beside it and for its length and script, and four transitions. Marked tokens of toxic documents
that this chain finds clean are labelled so, and it is fitted once more.

All documents are then scored whole. Words with a feature are rare, so forward and backward messages are carried over
the words between them by powers of the transition matrix, which is exact. A document's evidence is -ln of the share that
none of its words with a feature is in the toxic state, by their marginals; a logistic curve fitted on the sample turns it
into a score, so one sure word or several unsure ones make a document toxic.
Neighbouring words of marginal 0.5 or more form the offending spans (code points, end exclusive).

Defined cases: null and empty texts have no words and get the score of no evidence; rows with the same doc_id are scored
each; without labels of both classes nothing is learnt and every score is the share of toxic labels. An empty table gives no rows; a very long text is one row of a task;
other columns are never inputs, and drop_toxic returns them as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bytes_of, small
from .simhash import mixed, shingle_hashes

SAMPLE, SAMPLE_BYTES, THRESHOLD = 3000, 32 << 20, 0.7
#: Least texts of a feature, as a number and as a share of toxic ones; share of unlike ones; log odds and G-test of a feature.
TEXTS, SHARE, UNLIKE, LOG_ODDS, CHANCE = 6, 0.002, 0.6, 1.5, 30.0
SAME, CLEARER, WINDOW, STEPS, RATE, L2 = 0.8, 2.5, 24, 60, 0.3, 1e-3
#: Minimal hashes by which unlike texts are told; bytes of the beginnings of words that can be features; words whose
#: features a worker remembers; neighbouring words with a weight.
WIDTH, BEGINNINGS, REMEMBERED, COMMON = 4, range(3, 10), 100_000, 200
#: A word counts as carrying a weight from here on.
LEAST_WEIGHT = 1.0
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of labelled rows outside the held-out third."""
    return labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sample(docs: DataFrame, known: DataFrame) -> list[tuple[bytes, int]]:
    """(text, toxic) of the sample; its ids are a bounded set and so are broadcast."""
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (1, 0)]
    ids = {r["doc_id"]: r["toxic"] for p in picks for r in p.collect()}
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(sorted(ids.items()), "doc_id long, toxic int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    out, held = set(), 0
    for text, toxic in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic").toLocalIterator():
        held += len(text.encode())
        if held > SAMPLE_BYTES:
            break
        out.add((text.encode(), toxic))
    return sorted(out)


def features_of(word: bytes) -> list[bytes]:
    """Proper beginnings of a word, and the word itself with a mark at its end."""
    return [word[:k] for k in BEGINNINGS if k < len(word)] + [word + b"$"]


def candidates(rows: list[tuple[bytes, int]]) -> set[bytes]:
    """Features in many unlike toxic texts of the sample, and with higher odds there."""
    n = (sum(not y for _, y in rows), sum(y for _, y in rows))
    toxic, clean, memo = Counter(), Counter(), {}

    def own(text: bytes, known=None) -> set[bytes]:
        out: set[bytes] = set()
        for w in set(alnum_words(text)):
            if (fs := memo.get(w)) is None:
                fs = memo[w] = tuple(f for f in features_of(w) if known is None or f in known)
            out.update(fs)
        return out

    for text, y in rows:
        if y:
            toxic.update(own(text))
    toxic = Counter({f: c for f, c in toxic.items() if c >= max(TEXTS, SHARE * n[1])})
    memo.clear()
    for text, y in rows:
        if not y:
            clean.update(own(text, toxic))
    telling = {f for f in toxic if log_odds(toxic[f], clean[f], n) >= LOG_ODDS}
    memo.clear()
    sketches = defaultdict(lambda: [set() for _ in range(WIDTH)])
    for text, y in rows:
        if y and (mine := own(text, telling)):
            hashes = shingle_hashes(alnum_words(text), 3)
            least = [int(mixed(hashes, i).min()) for i in range(WIDTH)]
            for f in mine:
                for seen, x in zip(sketches[f], least, strict=True):
                    seen.add(x)
    return {f for f in telling if min(map(len, sketches[f])) >= max(TEXTS, UNLIKE * toxic[f])}


def counted(docs: DataFrame, known: DataFrame, features: set[bytes]) -> tuple[tuple[int, int], dict[bytes, tuple[int, int]]]:
    """Clean and toxic labelled texts, and how many of either hold each feature.

    Texts stay where they are: the numbers of a text's features meet its label, and only sums for the features return.
    """
    names = sorted(features)
    wanted = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, memo = wanted.value, {}
        for batch in small(batches):
            own = []
            for text in bytes_of(batch.column(1)):
                held: set[int] = set()
                for w in set(alnum_words(text)):
                    if (fs := memo.get(w)) is None:
                        if len(memo) >= REMEMBERED:
                            memo.clear()
                        fs = memo[w] = tuple(numbers[f] for f in features_of(w) if f in numbers)
                    if fs:
                        held.update(fs)
                own.append(sorted(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "f"])

    rows = docs.select("doc_id").join(known, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in rows}
    held = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<int>").where("size(f) > 0").join(known, "doc_id")
    sums = held.select(F.explode("f").alias("f"), "toxic").groupBy("f").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).collect()
    return (n.get(0, 0), n.get(1, 0)), {names[r["f"]]: (r["clean"], r["toxic"]) for r in sums}


def log_odds(toxic: int, clean: int, n: tuple[int, int]) -> float:
    return math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))


def beyond_chance(toxic: int, clean: int, n: tuple[int, int]) -> bool:
    """The log odds of a feature and the G-test of its share in toxic texts against its share in clean ones."""
    share = (toxic + clean) / (n[0] + n[1])
    g = sum(2 * x * math.log(x / (share * m)) for x, m in ((toxic, n[1]), (clean, n[0])) if x)
    return log_odds(toxic, clean, n) >= LOG_ODDS and g >= CHANCE


def special_of(telling: dict[bytes, tuple[int, float]]) -> set[bytes]:
    """Of features that stand for each other one; telling has numbers of toxic texts and log odds.

    A beginning gives way to a longer one that nearly all its texts hold, or that tells clearly more; of the others the
    shortest stays.
    """
    special: set[bytes] = set()
    for f, (n, odds) in sorted(telling.items()):
        if not any(g != f and g.startswith(f) and (m >= SAME * n or better >= odds + CLEARER) for g, (m, better) in telling.items()):
            special.add(f)
    return {f for f in special if not any(f[:k] in special for k in range(1, len(f)))}


class Features:
    """The feature of a word, if it has one."""

    def __init__(self, known: set[bytes]) -> None:
        self.known, self.lengths, self.seen = known, sorted({len(f) for f in known if not f.endswith(b"$")}), {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def __call__(self, word: bytes) -> bytes | None:
        try:
            return self.seen[word]
        except KeyError:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            whole = word + b"$"
            found = whole if whole in self.known else next((word[:k] for k in self.lengths if k < len(word) and word[:k] in self.known), None)
            self.seen[word] = found
            return found


def evidence(marginals: list[float]) -> float:
    return math.log1p(-sum(math.log(max(1e-4, 1 - p)) for p in marginals))


def around(words: list[bytes], i: int) -> tuple[bytes, bytes, bytes]:
    """Features of a marked token beside its own: the words before and after it, and its length and script."""
    word = words[i]
    before = b"<" + words[i - 1] if i else b"<"
    after = b">" + words[i + 1] if i + 1 < len(words) else b">"
    return before, after, b"#%d%d" % (min(len(word) // 4, 4), word.isascii())


class Chain:
    """States 0 (clean) and 1 (toxic): weights of marked tokens and a bias for state 1, and transition weights."""

    def __init__(self, weights: dict[bytes, float], bias: float, moves: np.ndarray, curve: tuple[float, float], context: dict[bytes, float] | None = None) -> None:
        self.weights = {w: x for w, x in weights.items() if abs(x) >= LEAST_WEIGHT}
        self.feature, self.context = Features(set(self.weights)), context or {}
        self.bias, self.moves, self.curve = bias, moves, curve
        # One step over a word without a weight, scaled; its powers carry messages over any number of them.
        self.step = np.exp(moves) * np.array([1.0, math.exp(bias)])
        self.step /= self.step.sum()
        self._powers: dict[int, np.ndarray] = {}

    def power(self, n: int) -> np.ndarray:
        """step ** n, scaled."""
        if n not in self._powers:
            if len(self._powers) > 20_000:
                self._powers.clear()
            out, base, k = np.eye(2), self.step, n
            while k:
                if k & 1:
                    out = out @ base
                    out /= out.sum()
                base = base @ base
                base /= base.sum()
                k >>= 1
            self._powers[n] = out
        return self._powers[n]

    def marginals(self, length: int, places: list[int], weights: list[float]) -> list[float]:
        """P(state 1) at the places, from messages over the whole chain of length words."""
        first = np.array([1.0, math.exp(self.bias)])
        lift = [np.array([1.0, math.exp(w)]) for w in weights]
        ahead, message, at = [], first, 0
        for place, up in zip(places, lift, strict=True):
            message = (message @ self.power(place - at)) * up
            message = message / message.sum()
            ahead.append(message)
            at = place
        behind, message, at, out = [], np.ones(2), length - 1, []
        for place, up in zip(reversed(places), reversed(lift), strict=True):
            message = self.power(at - place) @ message
            behind.append(message / message.sum())
            message, at = up * message / message.sum(), place
        for a, b in zip(ahead, reversed(behind), strict=True):
            both = a * b
            out.append(float(both[1] / both.sum()))
        return out

    def tagged(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        found = [(i, f) for i, f in enumerate(map(self.feature, words)) if f is not None]
        beside = self.context.get
        return [i for i, _ in found], self.marginals(len(words), [i for i, _ in found], [self.weights[f] + sum(beside(c, 0.0) for c in around(words, i)) for i, f in found]) if found else []

    def score(self, marginals: list[float]) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * evidence(marginals)))))


def _posteriors(unary: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 and expected transitions for windows (rows) of tokens; unary is the weight of state 1."""
    n, t = unary.shape
    up = np.stack([np.ones((n, t)), np.exp(unary)], axis=2)
    step = np.exp(moves)
    ahead, behind = np.empty((n, t, 2)), np.ones((n, t, 2))
    ahead[:, 0] = up[:, 0] / up[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, t):
        x = (ahead[:, k - 1] @ step) * up[:, k]
        ahead[:, k] = np.where(mask[:, k, None], x / x.sum(axis=1, keepdims=True), ahead[:, k - 1])
    for k in range(t - 2, -1, -1):
        x = (up[:, k + 1] * behind[:, k + 1]) @ step.T
        behind[:, k] = np.where(mask[:, k + 1, None], x / x.sum(axis=1, keepdims=True), behind[:, k + 1])
    both = ahead * behind
    p = both[:, :, 1] / both.sum(axis=2)
    pair = ahead[:, :-1, :, None] * step * (up * behind)[:, 1:, None, :]
    pair = pair / pair.sum(axis=(2, 3), keepdims=True) * mask[:, 1:, None, None]
    return p * mask, pair.sum(axis=(0, 1))


def fit(rows: list[tuple[bytes, int]], telling: set[bytes]) -> Chain:
    """The chain for the telling features, from the sample."""
    toxic = sum(y for _, y in rows)
    if not toxic or toxic == len(rows):
        share = toxic / len(rows) if rows else 0.0
        return Chain({}, 0.0, np.zeros((2, 2)), (math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0))
    feature = Features(telling)
    often = Counter()
    for text, _ in rows:
        often.update(set(alnum_words(text)))
    often = {w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:COMMON]} | {b""}
    windows = []  # tokens' features and whether the text is toxic
    for text, y in rows:
        words = alnum_words(text)
        marks = [i for i, w in enumerate(words) if feature(w)]
        for at in marks[:2] if marks else [0] if words else []:
            low = max(0, at - WINDOW // 2)
            found = [(f, *(c for c in around(words, i) if c[:1] == b"#" or c[1:] in often)) if (f := feature(words[i])) else () for i in range(low, min(len(words), low + WINDOW))]
            windows.append((found, y))
    number = {f: i for i, f in enumerate(sorted({f for found, _ in windows for fs in found for f in fs}), 1)}
    n = len(windows)
    ids, mask, gold = np.zeros((n, WINDOW, 4), np.int64), np.zeros((n, WINDOW), bool), np.zeros((n, WINDOW))
    for k, (found, y) in enumerate(windows):
        mask[k, : len(found)] = True
        for i, fs in enumerate(found):
            ids[k, i, : len(fs)] = [number[f] for f in fs]
            gold[k, i] = bool(y and fs)
    weights, bias, moves = _trained(ids, mask, gold)
    p, _ = _posteriors(weights[ids].sum(axis=2) + bias, mask, moves)
    weights, bias, moves = _trained(ids, mask, gold * (p >= 0.5))
    own = {f: float(weights[i]) for f, i in number.items() if f in telling}
    chain = Chain(own, bias, moves, (0.0, 1.0), {f: float(weights[i]) for f, i in number.items() if f not in telling})
    seen = np.array([evidence(chain.tagged(alnum_words(text))[1]) for text, _ in rows])
    # Both classes weigh as in the sample's labels; each gets one pseudo-row at either end.
    x, y = np.concatenate([seen, [0, 0, 3, 3]]), np.concatenate([[y for _, y in rows], [0, 0, 1, 1]])
    a, b = 0.0, 1.0
    for _ in range(60):  # Newton's method for two coefficients
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, [(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-2 * b])
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    chain.curve = (a, b)
    return chain


def _trained(ids: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights (number 0 is no feature), bias and transitions of most likelihood, by scaled gradient steps."""
    n, size = len(ids), int(ids.max(initial=0)) + 1
    a, b = gold[:, :-1].astype(int), gold[:, 1:].astype(int)
    true_moves = np.array([[((a == i) & (b == j) & mask[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)], float)
    weights, bias, moves = np.zeros(size), -2.0, np.zeros((2, 2))
    speed = [np.zeros(size), 0.0, np.zeros((2, 2))]  # sums of squared gradients
    for _ in range(STEPS):
        p, expected = _posteriors(weights[ids].sum(axis=2) + bias, mask, moves)
        error = (gold - p) * mask
        slopes = [np.bincount(ids.ravel(), np.repeat(error.ravel(), ids.shape[2]), size) / n * 50 - L2 * weights, error.sum() / n, (true_moves - expected) / n - L2 * moves]
        slopes[0][0] = 0.0
        speed = [s + g * g for s, g in zip(speed, slopes, strict=True)]
        weights, bias, moves = (x + RATE * g / (np.sqrt(s) + 1e-8) for x, g, s in zip((weights, bias, moves), slopes, speed, strict=True))
    return weights, float(bias), moves


def learnt(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain from docs (doc_id, text) and labels (doc_id, toxic)."""
    known = known_labels(labels)
    rows = sample(docs, known)
    n, held = counted(docs, known, candidates(rows)) if len({y for _, y in rows}) == 2 else ((0, 0), {})
    telling = special_of({f: (toxic, log_odds(toxic, clean, n)) for f, (clean, toxic) in held.items() if beyond_chance(toxic, clean, n)})
    return fit(rows, telling)


def spans_of(text: str, places: list[int], marginals: list[float]) -> list[int]:
    """Start and end of each run of neighbouring offending words."""
    wanted = {i for i, p in zip(places, marginals, strict=True) if p >= 0.5}
    out, last = [], -2
    if wanted:
        for i, m in enumerate(_WORD.finditer(text)):
            if i in wanted:
                if i == last + 1:
                    out[-1] = m.end()
                else:
                    out += [m.start(), m.end()]
                last = i
    return out


_SCORED = "_rid long, doc_id long, score double, spans array<int>"


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """Score and offending spans of every row of docs (_rid, doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for batch in small(batches):
            scores, spans = [], []
            for text in bytes_of(batch.column(2)):
                places, marginals = chain.tagged(alnum_words(text))
                scores.append(chain.score(marginals))
                spans.append(spans_of(text.decode(), places, marginals) if places else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.int32()))], names=["_rid", "doc_id", "score", "spans"])

    return docs.select("_rid", "doc_id", "text").mapInArrow(run, _SCORED)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more, in one pass over them; columns as before."""
    model = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for batch in small(batches):
            scores = [chain.score(chain.tagged(alnum_words(text))[1]) for text in bytes_of(batch.column(at))]
            yield batch.filter(pa.array([x < threshold for x in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
