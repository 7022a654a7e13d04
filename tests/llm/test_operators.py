"""Each operator against its plain version, on small tables with the awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from decidra.llm import chat, common, decontaminate, exact_dedup, licenses, pieces, pii, queries, simhash, suffix_dedup, toxicity, warc

from . import brute

SEED = random.Random(5)
VOCABULARY = ["".join(SEED.choice("abcdeéß") for _ in range(SEED.randint(1, 7))) for _ in range(60)]


def prose(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(11)
    base = [prose(rng.randint(1, 120), rng) for _ in range(40)]
    passage = prose(40, rng)
    texts = [*base, *base[:6], base[0].upper(), base[1] + " more", f"{prose(20, rng)} {passage} {prose(5, rng)}", f"{passage} {prose(30, rng)}", passage + passage]
    texts += [None, "", " \n", "a" * 3000, "ab" * 900, "x", "the same line\n" * 30, prose(4000, rng), "Mail a@b.co, c.d@e-f.org.uk@x.y 1.2.3.4.5.6.7.8 999.1.1.1 +1 (234) 567-8901 4111 1111 1111 1111 4111-1111-1111-1112 12", "MIT License and the Apache License, GNU General Public License"]
    near = base[5].split()
    for k in range(12):
        copy = list(near)
        copy[k * 3 % len(copy)] = f"w{k}"
        texts.append(" ".join(copy))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


DOCS = corpus()
ITEMS = [(1, DOCS[2][1]), (2, "ab cd"), (3, None), (4, ""), (5, DOCS[2][1]), (10, " ".join((DOCS[3][1] or "").split()[:12]))]


def docs_frame(spark, rows=None):
    frame = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string")
    return common.with_row_id(common.written(frame.repartition(3), "docs"))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A folder of tables as the queries read them, with columns that clash with inner names."""
    from pyspark.sql import functions as F

    base = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("_rid", F.lit("mine")).withColumn("fp", F.lit(1)).withColumn("key", F.lit(None).cast("string")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in DOCS], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "http://a.b/c", "<p>x</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("kind", F.lit(1)).withColumn("record", F.lit("x")).write.parquet(f"{base}/pages.parquet")
    turns = [(None, 0, "user", "no tree"), (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "back\\slash <\\| <|"), (2, 5, "assistant", None), (2, 5, "assistant", "b"), (2, None, None, "c"), (3, 0, "a\nb<|", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("t")).withColumn("node", F.lit(3)).withColumn("parent", F.lit(None).cast("int")).write.parquet(f"{base}/conversations.parquet")
    return base


def result(frame, width: int) -> dict:
    rows = frame.collect()
    out = {r[0]: tuple(r[1 : 1 + width]) for r in rows}
    assert len(out) == len(rows)
    return out


EXPECTED = {
    "op1_decontamination": lambda: brute.decontamination(DOCS, ITEMS),
    "op4_pii": lambda: brute.pii(DOCS),
    "op5_simhash": lambda: brute.simhash(DOCS),
    "op6_license_scan": lambda: brute.licenses(DOCS),
    "op9_exact_dedup": lambda: brute.exact(DOCS),
    "op10_suffix_array_dedup": lambda: brute.repeats(DOCS),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_query_equals_plain_version(spark, data, name):
    expected = EXPECTED[name]()
    assert result(queries.queries()[name](spark, data), len(next(iter(expected.values())))) == expected


def test_chat_reads_back(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = brute.chat([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert result(queries.op2_chat_formatting(spark, data), 4) == expected


def test_chat_tree_takes_the_best_branches(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "high", 5.0), ("t", 4, 3, "user", "more", 4.0), ("t", 9, 77, "user", "lost", 0.6), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), ("c", 3, 2, "user", "z", 1.0)]
    frame = spark.createDataFrame(nodes, "tree string, node int, parent int, role string, text string, score double")
    out = {(r.tree, r.leaf): (r["rank"], r.turns) for r in chat.formatted(frame).collect()}
    assert out == {("t", 4): (1, 3), ("t", 9): (2, 1), ("t", 2): (3, 2)}
    assert [(r.tree, r.leaf) for r in chat.formatted(frame, best=1).collect()] == [("t", 4)]


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, data, tmp_path, name):
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == (1 if name.startswith("op2") else 0)


REPEATED = [(None, "one text"), (None, "one text"), (4, "One text"), (4, "one text"), (4, "another\n" * 40), (5, None), (5, "mail kim@site.org MIT license")]


def repeated_expected(name: str) -> list[tuple]:
    """Rows of the same or no id are separate rows."""
    if name == "op9_exact_dedup":
        sizes = [4, 4, 4, 4, 1, 1, 1]
        keeps = [4, 4, 4, 4, 4, 5, 5]
        kept = [False, False, False, True, True, True, True]
        return [(d, k, n, y, brute.sha(brute.lower(t))) for (d, t), k, n, y in zip(REPEATED, keeps, sizes, kept, strict=True)]
    if name == "op10_suffix_array_dedup":
        one = brute.repeats([(0, "another\n" * 40)])[0]
        return [(d, *(one if t and len(t) > 99 else (len(t or ""), 0, 0, brute.sha(t or "")))) for d, t in REPEATED]
    if name == "op5_simhash":
        prints = [brute.simhash([(0, t)])[0][0] for _, t in REPEATED]
        return [(d, p, min(e for (e, _), q in zip(REPEATED, prints, strict=True) if p == q and e is not None)) for (d, _), p in zip(REPEATED, prints, strict=True)]
    single = {"op1_decontamination": lambda rows: brute.decontamination(rows, ITEMS), "op4_pii": brute.pii, "op6_license_scan": brute.licenses}[name]
    return [(d, *single([(0, t)])[0]) for d, t in REPEATED]


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_pii", "op5_simhash", "op6_license_scan", "op9_exact_dedup", "op10_suffix_array_dedup"])
def test_null_and_repeated_ids(spark, data, tmp_path, name):
    spark.createDataFrame(REPEATED, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = repeated_expected(name)
    rows = [tuple(r)[: len(expected[0])] for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", ["op3_sentencepiece", "op8_toxicity"])
def test_null_and_repeated_ids_give_equal_rows(spark, data, tmp_path, name):
    spark.createDataFrame(REPEATED, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [tuple(map(str, r)) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(r[0] for r in rows) == sorted(str(d) for d, _ in REPEATED) and rows.count(next(r for r in rows if r[0] == "None")) == 2


def test_row_ids_are_the_same_at_each_read(spark, tmp_path):
    spark.range(4000).repartition(5).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/t")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    seen = []
    for size, cost in ((1 << 27, 1 << 22), (2048, 512)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(cost))
        numbered = common.with_row_id(spark.read.parquet(f"{tmp_path}/t"))
        seen.append((numbered.rdd.getNumPartitions(), {r.id: r._rid for r in numbered.collect()}))
    for k, v in before.items():
        spark.conf.set(k, v)
    assert seen[0][0] < seen[1][0] and seen[0][1] == seen[1][1] and len(set(seen[0][1].values())) == 4000


def test_copies_in_two_levels(spark):
    """One text in every task, which goes through fewer tasks first, and some more."""
    rows = [(i, "the same page") for i in range(40)] + [(100 + i, f"page {i % 7}") for i in range(40)] + [(None, "the same page")]
    frame = common.with_row_id(common.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(12), "docs"))
    key = lambda out: sorted(map(repr, out.drop("text_sha256").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        one, two = (exact_dedup.exact_owners(frame, "largest", copies=n) for n in (1 << 20, 2))
        assert key(one) == key(two)
        assert {r.keep_id for r in two.collect() if r.group_size == 41} == {39}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_trie_spills_by_subtree():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for limit in (1 << 30, 3000):
        owners = exact_dedup.Owners(larger=False, limit=limit)
        for i, k in enumerate(keys):
            owners.add(k, (i, i), 1, [i])
        out = list(owners.results())
        assert all(key == keys[parts[0]] for key, _, _, parts in out)
        got = {p: (owner[0], n) for _, owner, n, parts in out for p in parts}
        first = {}
        for i, k in enumerate(keys):
            first.setdefault(k, i)
        assert got == {i: (first[k], keys.count(k)) for i, k in enumerate(keys)}


def test_shards_blocks_and_proximity(spark):
    docs = docs_frame(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontaminate.matches(docs, items).collect()}
    many = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontaminate.matches(docs, items, block_words=5, shard_words=50).collect()}
    assert one == many
    loose = docs_frame(spark, [(1, "aa xx bb cc"), (2, "aa xx xx xx xx bb cc"), (3, "aa bb cc")])
    near = decontaminate.matches(loose, spark.createDataFrame([(1, "aa bb cc")], "item_id long, text string"), size=3, reach=1)
    assert {r.doc_id: (r["items"], r.near_items) for r in near.collect()} == {1: ([], ["1"]), 2: ([], []), 3: (["1"], ["1"])}


def test_grid_bound_holds_and_cells_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(docs_frame(spark)).collect()} == {k: v[1] for k, v in brute.simhash(DOCS).items()}


def test_repeats_of_hot_cores(spark, data, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert result(queries.op10_suffix_array_dedup(spark, data), 4) == brute.repeats(DOCS)


def test_cores_are_ordered_group_by_group(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    rows = []
    for key in range(30):
        core = bytes(rng.choice(b"ab") for _ in range(120))
        for _ in range(rng.randint(1, 6)):
            first = rng.randint(0, suffix_dedup.WIDE - 1)
            rows.append((key, first, core[:first][::-1] + core[: suffix_dedup.SIZE], rng.randint(1, 50), len(rows), 7))
    names, types = ("key", "column", "piece", "doc", "rid", "start"), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    rows = [(k, c, p[: suffix_dedup.COLUMNS - c], d, r, s) for k, c, p, d, r, s in rows]

    def spans(together: int, size: int) -> set:
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), types, strict=True)], names=names) for i in range(0, len(rows), size)]
        return {(r["rid"], r["start"], r["stop"]) for b in suffix_dedup._classes(iter(batches)) for r in b.to_pylist()}

    whole = spans(10**9, 10**9)
    assert whole and whole == spans(1, 3) == spans(20, 7)


def test_op1_reports_proximity_matches(spark, tmp_path):
    item = "one two three four five six seven eight nine ten".split()
    docs = [(1, " ".join(["pad", *item, "pad"])), (2, " ".join([*item[:5], "extra", *item[5:]])), (3, " ".join([*item[:3], item[4], item[3], *item[5:]])), (4, " ".join(item[:9]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_items, r.contaminated, r.n_near, r.near_items) for r in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: (1, True, 1, "7"), 2: (0, False, 1, "7"), 3: (0, False, 1, "7"), 4: (0, False, 0, "")}


def test_near_copies_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    texts = [" ".join(f"v{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(30)]
    rows = list(enumerate(texts))
    for k in range(5):
        w = texts[k].split()
        w[50 + k] = "changed"
        rows.append((100 + k, " ".join(w)))
    frame = docs_frame(spark, [*rows, (200, None), (201, "")]).drop("_rid")
    assert sorted(r.doc_id for r in simhash.near_copies(frame).collect()) == [*range(30), 200, 201]


def jaccard(one: str, two: str, n: int = 5) -> float:
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (one.split(), two.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng: random.Random, kind: str, text: str, share: float) -> str:
    """Appended or replaced words at the end, or scattered ones, so that about this share of the shingles is new."""
    words = text.split()
    fresh = [f"n{rng.randint(0, 10**9)}" for _ in range(int(share * len(words)) + 1)]
    if kind == "appended":
        return " ".join(words + fresh)
    if kind == "replaced":
        return " ".join(words[: -len(fresh)] + fresh)
    for k in rng.sample(range(len(words)), max(1, len(fresh) // 5)):
        words[k] = fresh[0] + str(k)
    return " ".join(words)


def edited_pairs() -> list[tuple[str, str]]:
    rng = random.Random(21)
    out = []
    for kind in ("appended", "replaced", "scattered"):
        for k in range(40):
            text = " ".join(f"v{rng.randint(0, 5000)}" for _ in range(rng.choice((60, 200, 600))))
            out.append((text, edited(rng, kind, text, 0.04 + 0.006 * k)))
    return out


def groups_kept(rows: list[tuple], similarity: float = 0.8) -> list[int]:
    """All pairs, then the smallest id of each component."""
    root = {i: i for i, _ in rows}
    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            if root[i] != root[j] and jaccard(x, y) >= similarity:
                a, b = sorted((root[i], root[j]))
                root = {n: a if r == b else r for n, r in root.items()}
    return sorted(set(root.values()))


def test_near_copies_meet_whatever_the_edit(spark):
    pairs = [(x, y) for x, y in edited_pairs() if jaccard(x, y) >= 0.8]
    assert len(pairs) > 40
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    assert sorted(r.doc_id for r in simhash.near_copies(docs_frame(spark, rows).drop("_rid")).collect()) == [2 * k for k in range(len(pairs))]


def test_near_copies_are_verified_at_the_similarity(spark):
    texts = [x for pair in edited_pairs() for x in pair]
    both = [jaccard(x, y) for x, y in edited_pairs()]
    assert sum(0.8 <= s < 0.84 for s in both) > 4 and sum(0.76 < s < 0.8 for s in both) > 4
    rng = random.Random(3)
    base = [f"v{rng.randint(0, 5000)}" for _ in range(100)]
    # Each has its own last words, and a common line stands in texts that are otherwise unlike.
    texts += [" ".join(base[: 100 - k % 14] + [f"m{k}x{i}" for i in range(k % 14)]) for k in range(40)]
    texts += [" ".join(base[:12] + [f"z{k}x{i}" for i in range(30)]) for k in range(20)]
    rows = list(enumerate(texts))
    assert sorted(r.doc_id for r in simhash.near_copies(docs_frame(spark, rows).drop("_rid")).collect()) == groups_kept(rows)


def test_pieces_are_lossless_reproducible_and_sampled(spark):
    texts = ["", "a  b\n\n c ▁d", "héllo wörld " * 9, "\U0001f600" * 40, "x" * 500, "the the the the the the the the"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, two = pieces.encoded(frame.coalesce(1)), pieces.encoded(frame.repartition(4))
    got = {r.doc_id: r.tokens for r in one.collect()}
    assert got == {r.doc_id: r.tokens for r in two.collect()}
    assert all(r.lossless for r in one.collect())
    assert {r.doc_id: r.text for r in pieces.decoded(one).collect()} == dict(enumerate(texts))
    other = {r.doc_id: r.tokens for r in pieces.encoded(frame, seed=8).collect()}
    assert other != got


def test_lattice_deals_edges_in_the_order_of_a_sort():
    """Parts of the edges end at different bytes, so they are dealt to their nodes without a sort of all edges."""
    vocabulary = pieces.pieces(pieces.MODEL, 1.0)
    units = ["the".encode(), " naïve".encode(), "日本語\U0001f600".encode(), b"\n", b"x" * 300, " ▁".encode(), b" "]
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.array([len(u) for u in units])
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    assert all(len(set(after.tolist())) == len(after) for _, after, _ in vocabulary.edges_by_size(data, left))
    first, after, ids = vocabulary.edges(data, left)
    order = np.lexsort((after, place[after - 1]))
    _, number, source, got, ladder = vocabulary.lattice(units)
    assert got.tolist() == ids[order].tolist() and source.tolist() == place[first[order]].tolist()
    assert number[after[order] - 1].tolist() == (np.ceil(ladder) - 1).astype(int).tolist()


def test_pieces_equal_plain_version(spark, data):
    vocabulary = pieces.pieces(pieces.MODEL, pieces.THETA)
    got = {r.doc_id: r.tokens for r in queries.op3_sentencepiece(spark, data).collect()}
    for doc, text in DOCS:
        assert got[doc] == brute.sampled((text or "").encode(), pieces.row_key(doc, pieces.SEED), vocabulary, pieces._uniform)


def test_long_units_and_segments_draw_the_same(monkeypatch):
    vocabulary, rng = pieces.pieces(pieces.MODEL, 1.0), random.Random(1)
    unit = "".join(rng.choice("abcdefgh\u00e9\u4e16") for _ in range(2000)).encode()
    text = (b"the cat sat " + unit + b" on the mat\n") * 3
    whole = pieces.sampled([text], [7], vocabulary)[0].tolist()
    monkeypatch.setattr(pieces, "LONG", 90)
    assert pieces.sampled([text], [7], vocabulary)[0].tolist() == whole
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 500)
    parts = [pieces.sampled([part], [7], vocabulary, [at])[0].tolist() for at, part in pieces.segments(text, 500)]
    assert len(parts) > 1 and sum(parts, []) == whole == pieces.tokens_of([text], [7], vocabulary)[0].tolist()
    assert vocabulary.decode(whole) == text


def test_sampling_follows_the_lattice():
    vocabulary = pieces.pieces(pieces.MODEL, 1.0)
    unit, n = b"the", 20_000
    ways = {}

    def walk(at, ids, weight):
        if at == len(unit):
            ways[tuple(ids)] = weight
        for end in range(at + 1, len(unit) + 1):
            if (k := vocabulary.ids.get(unit[at:end])) is not None:
                walk(end, [*ids, k], weight * 2.718281828459045 ** vocabulary.weight[k])

    walk(0, [], 1.0)
    drawn = [tuple(x.tolist()) for x in pieces.sampled([unit] * n, [pieces.row_key(i, 1) for i in range(n)], vocabulary)]
    total = sum(ways.values())
    for ids, weight in ways.items():
        assert abs(drawn.count(ids) / n - weight / total) < 0.015


def test_pii_terms_and_sanitising(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"notes by zorblax for kim@site.org today {'calm' if i else 'loud'}") for i in range(3)] + [(10 + i, "notes by day for all today, calm and loud " * 3) for i in range(600)]
    docs = docs_frame(spark, rows)
    found = {r.doc_id: r for r in pii.sanitised_documents(docs, pii.spans(docs)).select("doc_id", pii.named(F.col("spans")).alias("named"), "text").collect()}
    assert (found[1].named, found[1].text) == ("term:9:16,email:21:33", "notes by [TERM] for [EMAIL] today calm")
    assert found[12].named == "" and found[12].text == rows[5][1]
    removed = pii.sanitised_documents(docs, pii.spans(docs), generalise=False).where("doc_id = 1").first()
    assert removed.text == "notes by  for  today calm"


def test_pii_terms_go_wherever_they_stand(spark):
    """Far from the entity, in texts without it, and also for an entity that a third of all texts hold."""
    from pyspark.sql import functions as F

    filler = " ".join(f"w{k % 7}" for k in range(40))
    rows = [(i, f"desk of quux mail all@hot.org {filler} quux end") for i in range(40)] + [(100, f"only quux {filler}")] + [(200 + i, filler) for i in range(80)]
    docs = docs_frame(spark, rows)
    spans = {r.doc_id: r.named for r in pii.spans(docs).select("doc_id", pii.named(F.col("spans")).alias("named")).collect()}
    text = dict(rows)
    assert text[100][5:9] == "quux" and spans[100] == "term:5:9"
    at = text[3].rindex("quux")
    assert f"term:{at}:{at + 4}" in spans[3] and "term" not in spans[205]


def test_pii_in_a_text_of_very_many_entities(spark):
    import time

    n = 10_000
    text = " ".join(f"user{i}@site{i % 7}.org wrote on day {i}" for i in range(n))
    docs = docs_frame(spark, [(1, text)])
    began = time.perf_counter()
    row = pii.sanitised_documents(docs, pii.spans(docs)).first()
    assert len(row.base) == n and row.text.startswith("[EMAIL] wrote on day 0 [EMAIL] ") and row.text.endswith(f"wrote on day {n - 1}")
    assert time.perf_counter() - began < 60  # a square of it takes hours


def test_license_labels(spark):
    rows = [(1, f"x {licenses.TEMPLATES['cc-by-nc'][0]} y"), (2, licenses.TEMPLATES["mit"][1]), (3, "permission to copy software"), (4, "The MIT license. mit License")]
    got = {r.doc_id: (r.labels, r.base_labels, r.n_base) for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert got == {1: (["cc-by-nc"], [], 0), 2: (["mit"], [], 0), 3: ([], [], 0), 4: (["mit"], ["mit"], 2)}


def test_license_words_more_or_less(spark):
    isc = "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"
    mit = licenses.TEMPLATES["mit"][1].split()
    mit[40:40] = ["one", "two"]
    del mit[60]
    apart = " ".join(licenses.TEMPLATES["bsd"][0].split()[30:]) + " x" * 300 + " redistribution and use in source and binary forms"
    dnl = "\n".join(f"dnl {line}" for line in licenses.TEMPLATES["gpl"][1].split("\n"))
    rows = [(1, isc), (2, " ".join(mit)), (3, apart), (4, dnl)]
    assert {r.doc_id: r.labels for r in licenses.scan(docs_frame(spark, rows)).collect()} == {1: ["isc"], 2: ["mit"], 3: [], 4: ["gpl"]}


def test_license_labels_equal_plain_version(spark):
    """Labels of the sample documents and of notices with words changed, against every possible place."""
    rng = random.Random(12)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for k, (label, texts) in enumerate(licenses.TEMPLATES.items()):
        words = texts[-1].split()
        for share in (0.1, 0.5):
            changed = [f"c{rng.randint(0, 99)}" if rng.random() < share else x for x in words]
            rows.append((10_000 + 10 * k + int(10 * share), f"{prose(8, rng)} {' '.join(changed)} {prose(8, rng)} {licenses.MANDATORY[label][0]}"))
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    seen = set()
    for doc, text in rows:
        best = brute.license_labels(text, licenses.TEMPLATES, licenses.MANDATORY, licenses.SHARE, licenses.SHIFT)
        base = {x for x in brute.licenses([(doc, text)])[doc][4].split(",") if x}
        assert set(got[doc].labels) == base | set(best)
        assert got[doc].score == max([0.5 * bool(base), *best.values()])
        seen |= set(best)
    assert len(seen) >= 8


def test_license_labels_just_above_the_share(spark, monkeypatch):
    """Every template with its phrase and as few distinct words as leave 0.7 of its places: words that stand once are changed first."""
    from collections import Counter

    rows, doc = [], 0
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            words, often = t.split(), Counter(t.split())
            phrase = next(p.split() for p in licenses.MANDATORY[label] if f" {p} " in f" {t} ")
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            free = sorted((i for i in range(len(words)) if not at <= i < at + len(phrase)), key=lambda i: (often[words[i]], i))
            for change in range(len(words) // 6, int(0.3 * len(words)) + 1):
                if change in (len(words) // 6, int(0.3 * len(words))):
                    lost = set(free[:change])
                    doc += 1
                    rows.append((doc, " ".join(["pad", *(f"q{i}" if i in lost else w for i, w in enumerate(words)), "pad"])))
    monkeypatch.setattr(licenses, "REACH", 50)
    found = 0
    for reach in (50, 1 << 16):
        monkeypatch.setattr(licenses, "REACH", reach)
        for _, text in rows:
            codes = licenses.INDEX.codes(common.alnum_words(text.encode()))
            best = brute.license_labels(text, licenses.TEMPLATES, licenses.MANDATORY, licenses.SHARE, licenses.SHIFT)
            assert licenses.aligned(codes, [0.0] * len(licenses.INDEX.number)) == best
            found += bool(best)
    assert found == 2 * len(rows) >= 80
    long = " the mit license of ".join(text for _, text in rows)
    got = {r.doc_id: r.labels for r in licenses.scan(docs_frame(spark, [*rows, (0, long)])).collect()}
    assert all(got[d] for d, _ in rows) and len(got[0]) == len(licenses.TEMPLATES)


def test_warc_equals_plain_version(spark, data):
    """The sample pages, a page with awkward marks, and the fixture's null and repeated rows."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(-1, "u v\nw", "a < b <p>c<br/>d &amp;lt; <b>e</b><SCRIPT>x</Script > f<!-- g --> <svg><a>h</a></svg><a class=k href='q\n r'>i</a> <?p?>j <!doctype k> l</p"), (-2, None, "<head><title>T <i>u</i></title><p>v</head>w<title>z</title>")]
    rows = warc.digests(warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")))).collect()
    got = [(r.page_id, r.kind, r.record_id, r.refers_to, r.source_digest, r.block_digest, r.content_length, r.record_sha256) for r in rows]
    assert sorted(got, key=repr) == brute.warc(pages)


@pytest.mark.parametrize("piece", ["<a", "<title>", "<script>", "<a href=\"", "<!--", "<", "&", "</script "])
def test_warc_is_linear_in_hostile_pages(piece):
    import time

    began = time.perf_counter()
    warc.Page(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 5


def test_warc_records_link_back(spark):
    page = "<html lang=de><head><title>A &amp; B</title><style>p{}</style></head><body><p>One <b>two</b></p><script>bad()</script><a href='/x?a=1&amp;b=2'>three</a></body></html>"
    rows = warc.derivatives(warc.responses(spark.createDataFrame([(7, "http://h/p", page)], "page_id long, url string, html string"))).collect()
    by = {r.kind: r for r in rows}
    assert by["conversion"].block == "One two\nthree"
    assert by["conversion"].refers_to == by["metadata"].refers_to and by["conversion"].record_id in by["metadata"].block
    assert "title: A & B\r\n" in by["metadata"].block and "outlink: /x?a=1&b=2\r\n" in by["metadata"].block
    assert by["conversion"].source_digest == warc.digest(page.encode()) and f"WARC-Block-Digest: {warc.digest(b'One two\nthree')}".encode() in by["conversion"].record


def test_toxicity_learns_words_and_places(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        w = [rng.choice(VOCABULARY) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randint(0, 60), rng.choice(["vile", "nasty"]))
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = docs_frame(spark, [*rows, (1000, ""), (1001, None)])
    found = {r.doc_id: r for r in toxicity.scored(docs, toxicity.learnt(docs, labels)).collect()}
    held = [r.doc_id for r in labels.where(toxicity.held_out(labels.doc_id)).collect()]
    assert len(held) > 50 and all((found[i].score >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    text = dict(rows)[0]
    assert {text[a:b] for a, b in zip(found[0].spans[::2], found[0].spans[1::2], strict=True)} <= {"vile", "nasty", "vile nasty", "nasty vile"}
    assert found[1000].score == found[1001].score < toxicity.THRESHOLD


def test_toxicity_scores_equal_plain_version_and_hold_out(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.learnt(docs, labels)
    scored = common.written(toxicity.scored(common.with_row_id(docs), chain), "scored")
    held = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    counts = {(r.toxic, r.p): r["count"] for r in held.groupBy("toxic", (F.col("score") >= toxicity.THRESHOLD).alias("p")).count().collect()}
    assert counts[1, True] / (counts[1, True] + counts[1, False]) > 0.85 and counts[0, False] / (counts[0, True] + counts[0, False]) > 0.98
    some = scored.join(docs.select("doc_id", "text"), "doc_id").where("doc_id < 600").collect()
    assert len(some) > 100 and any(r.spans for r in some)
    for r in some:
        assert abs(r.score - brute.chain_score(chain, r.text)) < 1e-9


def test_chain_marginals_equal_enumeration():
    import itertools
    import math

    import numpy as np

    moves, bias, weights = np.array([[0.3, -0.7], [0.1, 0.9]]), -0.4, {2: 1.5, 3: -2.0, 6: 2.2}
    chain = toxicity.Chain({}, bias, moves, (0, 1))
    n, total, one = 8, 0.0, {i: 0.0 for i in weights}
    for states in itertools.product((0, 1), repeat=n):
        x = math.exp(sum(s * (bias + weights.get(i, 0)) for i, s in enumerate(states)) + sum(moves[a, b] for a, b in itertools.pairwise(states)))
        total += x
        for i in one:
            one[i] += x * states[i]
    assert np.allclose(chain.marginals(n, list(weights), list(weights.values())), [one[i] / total for i in weights])


def test_columns_give_order_and_prefixes():
    import numpy as np

    rng = np.random.default_rng(4)
    table = rng.integers(97, 99, (50, 20)).astype(np.uint8)
    for c, order, prefix in suffix_dedup.construct(lambda c: table[:, c], 50, 20):
        rows = [table[i, c:].tobytes() for i in order]
        assert rows == sorted(rows)
        for k in range(1, 50):
            common_part = next((j for j in range(20 - c) if rows[k][j] != rows[k - 1][j]), 20 - c)
            assert prefix[k] == common_part


def test_texts_of_several_megabytes(spark, tmp_path):
    """One text crosses the pieces, blocks, segments and shards of every operator; it repeats its beginning at its end."""
    rng = random.Random(4)
    body = rng.randbytes(2_300_000).hex()
    body = " ".join(body[i : i + 8] for i in range(0, len(body), 8))
    text = body + "\n" + body[:400]
    rows = [(2, text), (1, body[100:250]), (3, text.upper())]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, body[-300:])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {name: {r.doc_id: r for r in queries.queries()[name](spark, str(tmp_path)).collect()} for name in ("op1_decontamination", "op3_sentencepiece", "op9_exact_dedup", "op10_suffix_array_dedup")}
    words = brute.words(text)
    assert (got["op1_decontamination"][2].n_words, got["op1_decontamination"][2].n_items) == (len(words), 1)
    assert all(r.lossless for r in got["op3_sentencepiece"].values())
    assert got["op9_exact_dedup"][2].keep_id == 3 and got["op9_exact_dedup"][2].group_size == 2
    ten = got["op10_suffix_array_dedup"]
    assert (ten[1].n_removed, ten[2].n_spans, ten[2].n_removed, ten[2].n_bytes) == (0, 2, 550, len(text))
    assert ten[2].kept_sha256 == brute.sha(text[:100] + text[250 : len(body) + 1])


@pytest.mark.parametrize("rows", [[], REPEATED])
def test_pipeline_stages_on_awkward_tables(spark, data, tmp_path, rows):
    """Empty tables, null and repeated ids, null texts: each stage keeps clean rows and all columns."""
    import corpus_pipeline

    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(10 if rows else 0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "docs")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs.count())
        assert docs.columns == ["doc_id", "text"]
    assert kept == ([7, 4, 4, 4] if rows else [0, 0, 0, 0])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == kept[-1]


def test_pipeline_runs_and_decides(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, data), name)
        assert docs.columns == columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept)) < len(DOCS)
    lowered = [brute.lower(dict(DOCS)[i]) for i in kept]
    assert len(set(lowered)) == len(lowered)
    dirty = {i for i, x in brute.decontamination(DOCS, ITEMS).items() if x[4]}
    assert not dirty & set(kept)
