"""Token counts, prefix trie and collocations against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from decidra.llm import collocations, common, prefix_trie, queries, tokens

from .brute import lower, sha
from .test_operators import DOCS, REPEATED, data  # noqa: F401

FOLDER = "/opt/tokenizers"


def library(path: str, texts: list[str | None]) -> list[int]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    import sentencepiece

    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([x or "" for x in texts])]


AWKWARD = ["", " ", "  a", "a ", "a  ", "a b", "\n", "\n\n a", "▁", "a▁ b", "a ▁b", "<s> </s> <unk> <|endoftext|>", "日本語 テキスト 中文", "tab\there", "x" * 5000, "é" * 900, "word " * 4000, "no blanks here".replace(" ", "") * 400]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_lengths_are_the_library_s(name):
    path, rng = f"{FOLDER}/{name}", random.Random(4)
    texts = [*AWKWARD, *("".join(rng.choice("ab  \n\t▁é中文<s>.X") for _ in range(rng.randint(0, 60))) for _ in range(400))]
    model = tokens.opened(path)
    expected = library(path, texts)
    assert model.lengths(texts) == expected
    for size in (1, 5, 700):
        parts = [list(model.parts(x, size)) for x in texts]
        assert [sum(model.lengths([p])[0] - less for p, less in x) for x in parts] == expected
    assert len(list(model.parts("word " * 4000, 700))) > 20


def test_token_counts_of_a_table(spark, data, tmp_path):  # noqa: F811
    texts = [t for _, t in DOCS]
    expected = sorted((d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(DOCS, library(tokens.MODEL, texts), strict=True))
    assert sorted(map(tuple, queries.op11_token_counts(spark, data).collect())) == expected
    rows = [*REPEATED, (9, "a long text, " * 60_000), (9, "x" * 400_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted(((d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(rows, library(tokens.MODEL, [t for _, t in rows]), strict=True)), key=repr)
    assert sorted(map(tuple, queries.op11_token_counts(spark, str(tmp_path)).collect()), key=repr) == expected


def test_batches_by_bytes():
    import numpy as np

    assert list(tokens.batched(np.array([3, 3, 9, 1, 0, 1]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(tokens.batched(np.array([], dtype=int), 6)) == []


def trie(rows: list[tuple]) -> set:
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return {(min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(kids[x]), leaves[x], saved[x], sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(x)))))) for x, m in members.items()}


def conversations(rng: random.Random) -> list[tuple]:
    rows = [(None, 1, "user", "lost")]
    for c in [*range(0, 30), *range(200, 212), 305, -1, -207, 10**15]:
        for turn in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "hello there"])))
    rows += [(400, t, "user", f"t{t}") for t in range(300)] + [(401, t, "user", f"t{t}") for t in range(290)]
    return [*rows, *rows[5:15]]


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 3])
def test_trie_equals_plain_version(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(random.Random(2))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = queries.op12_prefix_trie(spark, str(tmp_path))
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got)) and set(got) == trie(rows)


def test_trie_of_the_awkward_table(spark, data):  # noqa: F811
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op12_prefix_trie(spark, data).collect()} == trie(rows)


def test_ends_of_a_node_in_many_chunks():
    ids = list(range(30_000))
    rows = [pa.RecordBatch.from_arrays([pa.array([d] * len(x)), pa.array([0] * len(x)), pa.array(x)], names=["depth", "conv_id", "conv"]) for d, x in ((1, ids[:20_000]), (1, ids[20_000:]), (2, [5]))]
    chunks = list(prefix_trie._chunks(iter(rows)))
    assert len(chunks) > 3
    got = {r["depth"]: r["ends"] for b in prefix_trie._digests(iter(chunks)) for r in b.to_pylist()}
    assert got == {1: sha(",".join(map(str, ids))), 2: sha("5")}


def phrases(rows: list[tuple], top: int = 2000, least: int = 10) -> set:
    import re

    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            for n in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, counts in f.items():
        longest = Counter()
        for p, c in counts.items():
            if len(p) == 3 and c >= least:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], c)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and 100 * longest[p] >= 50 * a):
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        n = sum(c for p, c in counts.items() if len(p) == 1)
        out |= {(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}
    return out


def corpus(rng: random.Random) -> list[tuple]:
    words = ["the", "The", "of", "a", "\x01", "a\x01", "a\x1f", "é", "ß", "x" * 90, "new", "york", "　", "z"]
    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 90)))) for _ in range(120)]
    return [*rows, ("en", None), ("en", ""), ("none", " .,; "), *[("en", "new york city hall. A b c d")] * 25, *[("fr", "un deux trois " * 40)] * 2]


def test_collocations_equal_plain_version(spark, tmp_path):
    rows = corpus(random.Random(9))
    spark.createDataFrame([(i, *r, "mine") for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    frame = queries.op13_collocations(spark, str(tmp_path))
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got)) and set(got) == phrases(rows)
    some = [tuple(r) for r in collocations.collocations(common.table(spark, str(tmp_path), "documents"), least=3, top=4).collect()]
    assert set(some) == phrases(rows, 4, 3)


def test_shards_pieces_and_ranges_give_the_same_counts(monkeypatch):
    rng = random.Random(3)
    rows = corpus(rng)

    def merged(limit: int, piece: int, held: int, chunk: int, words: int, n_cuts: int) -> dict:
        for name, value in (("LIMIT", limit), ("PIECE", piece), ("HELD", held), ("CHUNK", chunk), ("WORDS", words)):
            monkeypatch.setattr(collocations, name, value)
        batches = [pa.RecordBatch.from_arrays([pa.array(["und" if x is None else x for x, _ in part]), pa.array([x for _, x in part])], names=["lang", "text"]) for part in (rows[:50], rows[50:70], rows[70:])]
        every = sorted({(lang.encode(), *collocations.key(c, w)) for lang, w, codes, _ in collocations._tries(iter(batches)) for c in codes.tolist()})
        at = sorted(rng.sample(every, n_cuts))
        pieces = sorted((r for b in (x for y in (batches[:1], batches[1:]) for x in collocations._dealt(at)(iter(y))) for r in b.to_pylist()), key=lambda r: (r["range"], r["lang"], r["first"]))
        table = pa.Table.from_pylist(pieces, pa.schema([("range", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("first", pa.list_(pa.binary())), ("size", pa.int64()), ("data", pa.binary())]))
        out = {}
        for batch in collocations._merged(1)(iter(table.to_batches(max_chunksize=7))):
            for r in batch.to_pylist():
                name = (r["lang"], r["phrase"]) if r["depth"] else (r["lang"], None)
                assert name not in out
                out[name] = (r["a"], r["lefts"])
        return out

    whole = merged(10**7, 10**6, 10**7, 1 << 21, 10**6, 0)
    assert all(None not in lefts for _, lefts in whole.values())
    expected = Counter()
    for lang, text in rows:
        for k, v in {("und" if lang is None else lang, b" ".join(p)): n for p, n in _grams(text).items()}.items():
            expected[k] += v
    assert {k: a for k, (a, _) in whole.items() if k[1] is not None} == dict(expected)
    for sizes in ((50, 7, 30, 64, 10**6, 40), (200, 3, 1, 200, 8, 5), (10**7, 1, 10, 17, 10**6, 100)):
        other = merged(*sizes)
        assert {k: a for k, (a, _) in other.items()} == {k: a for k, (a, _) in whole.items()}
        assert all(x is None or x == y for k, (_, lefts) in other.items() for x, y in zip(lefts, whole[k][1], strict=True))


def _grams(text: str | None) -> Counter:
    import re

    out = Counter()
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
        w = [x.encode() for x in re.findall("[^ \t]+", piece)]
        for n in (1, 2, 3):
            out.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return out
