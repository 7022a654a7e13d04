"""Rows of training and evaluation data from steps, items and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra import schemas
from decidra.functions import numeric as N
from decidra.functions import text as X

from .sampling import chosen

# The phrasings of the questions.
EFFECT = ["Did the last action change the page as intended?", "Compare the two screenshots: did the action take effect?"]
DONE = ["Is the task already complete on this screen?", "Has the goal been fully achieved, with nothing left to do?"]
SKIP = ["Can this element be skipped because it already satisfies the task?", "Has this element already been handled for the task (no action needed on it)?"]
GROUND = "Which numbered element should be acted on next to make progress on the task?"
NONE = "none of the marked elements is the right target"
#: Rows that are ordered together to find partners.
PARTNERS = 100_000


def question(qid: str, qtype: str, instructions: Column, criteria: Column | None = None) -> Column:
    return F.struct(F.lit(qid).alias("qid"), F.lit(qtype).alias("qtype"), instructions.alias("instructions"), (criteria if criteria is not None else F.array().cast(schemas.CRITERIA)).alias("criteria"))


def levels(texts: Column) -> Column:
    """Criteria of a score: keys are the levels from 0 on."""
    return F.transform(texts, lambda t, i: F.struct(i.cast("string").alias("key"), t.alias("descr")))


def phrased(options: list[str], key: Column, seed: str) -> Column:
    return chosen(F.array(*[F.lit(x) for x in options]), key, seed)


def state_rows(steps: DataFrame, validation_sites: int = 30, skips: int = 2, seed: str = "0") -> DataFrame:
    """One step becomes an effect row, two done rows, up to 2 * skips balanced skip rows and, for half of them, a ground row.

    The last sites by first appearance are the validation split. One pass: rows of a step are an array that is exploded.
    """
    steps = steps.where("error is null")
    first = steps.groupBy("site").agg(F.min("id").alias("_first"))
    held = first.orderBy(F.desc("_first")).limit(validation_sites).select("site", F.lit("validation").alias("split"))
    rows = steps.join(held, "site", "left").withColumn("split", F.coalesce("split", F.lit("train")))
    at = lambda k: X.first(F.filter("candidates", lambda c: c["k"].cast("string") == k))["text"]
    state = X.rendered_state(F.col("goal"), F.col("history"))
    act = F.concat(F.col("action"), F.lit(" on "), F.coalesce(at(F.col("chosen")), F.lit("?")), F.when(F.col("typed") != "", F.concat(F.lit(" typed '"), F.col("typed"), F.lit("'"))).otherwise(""))
    after = X.rendered_state(F.col("goal"), F.concat("history", F.array(X.acted(F.col("action"), at(F.col("chosen")), F.col("typed")))))

    def row(kind: str, images: Column, text: Column, instructions: Column, label: Column, qtype: str = "noul", criteria: Column | None = None, candidate: Column | None = None, which: str | None = None) -> Column:
        return F.struct(images.alias("images"), text.alias("state"), question(kind, qtype, instructions, criteria).alias("question"), label.cast("string").alias("target"), (candidate if candidate is not None else F.lit(None).cast("string")).alias("candidate"), F.lit(which).cast("string").alias("which"))

    before, both = F.array("before_img"), F.array("before_img", "after_img")
    ranked = F.array_sort(F.transform("labels.skip", lambda s: F.struct(N.hash_order(F.concat_ws(":", "id", s["k"].cast("string")), seed).alias("h"), s["k"].alias("k"), s["v"].alias("v"))))
    picks = F.concat(F.slice(F.filter(ranked, lambda s: s["v"] == 1), 1, skips), F.slice(F.filter(ranked, lambda s: s["v"] == 0), 1, skips))
    skip = F.transform(picks, lambda s: row("skip", before, F.concat(state, F.lit("Candidate "), s["k"].cast("string"), F.lit(": "), at(s["k"].cast("string")), F.lit("\n")), phrased(SKIP, F.col("id"), seed), s["v"], candidate=s["k"].cast("string")))
    criteria = F.concat(F.transform("candidates", lambda c: F.struct(c["k"].cast("string").alias("key"), c["text"].alias("descr"))), F.array(F.struct(F.lit("none").alias("key"), F.lit(NONE).alias("descr"))))
    asked = (F.coalesce("target_idx", F.lit("")) != "") & (F.col("labels.done_before") == 0) & (N.hash_unit(F.col("id"), f"{seed}/ground") < 0.5)
    every = F.concat(
        F.when(F.col("labels.noisy") == 0, F.array(row("effect", both, F.concat(state, F.lit("Last action: "), act, F.lit("\n")), phrased(EFFECT, F.col("id"), seed), F.col("labels.effect")))).otherwise(F.array()),
        F.array(row("done", before, state, phrased(DONE, F.col("id"), f"{seed}/b"), F.col("labels.done_before"), which="before"), row("done", F.array("after_img"), after, phrased(DONE, F.col("id"), f"{seed}/a"), F.col("labels.done_after"), which="after")),
        skip,
        F.when(asked, F.array(row("ground", before, state, F.lit(GROUND), F.col("target_idx"), "choice", criteria))).otherwise(F.array()),
    )
    return rows.select(F.col("id").alias("step_id"), "site", "split", "goal_kind", "before_url", "after_url", F.explode(every).alias("r")).select("step_id", "site", "split", "goal_kind", "before_url", "after_url", "r.*")


def to_items(rows: DataFrame) -> DataFrame:
    """Benchmark items of rows (schemas.ROW): the first question of each."""
    q, t = X.first(F.col("questions")), X.first(F.col("targets"))
    return rows.select(
        X.item_id(F.col("meta.step_id"), q["qid"], F.col("meta.candidate"), F.col("meta.which")).alias("id"),
        q["qid"].alias("question"),
        q["qtype"].alias("type"),
        q["instructions"].alias("instructions"),
        q["criteria"].alias("criteria"),
        "state",
        F.transform("images", lambda x: F.substring_index(x, "/", -1)).alias("images"),
        F.coalesce(t["hard"], F.round(t["p_yes"]).cast("int").cast("string")).alias("label"),
        F.col("meta.site").alias("site"),
        F.col("meta.step_id").alias("step_id"),
        F.col("meta.candidate").alias("candidate"),
        F.col("meta.which").alias("which"),
    )


def duplicate_ids(items: DataFrame, key: str = "id") -> DataFrame:
    return items.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def checked_unique(items: DataFrame, key: str = "id") -> DataFrame:
    """items; the query fails where a key occurs twice."""
    n = items.agg((F.count("*") - F.count_distinct(key)).alias("n"))
    if n.where(F.col("n") > 0).count():
        raise ValueError(f"{key} is not unique")
    return items


def joined_judgements(items: DataFrame, judged: DataFrame) -> DataFrame:
    """Predictions by step, question, candidate and which, where null equals the empty text; the last judgement counts."""
    keys = ["step_id", "question", "candidate", "which"]
    clean = lambda df: df.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], *[c for c in df.columns if c not in keys])
    last = clean(judged).groupBy(*keys).agg(F.max_by(F.struct("p", "choice"), "ord").alias("j"))
    return clean(items).join(last, keys, "left").select("id", "j.p", "j.choice", F.col("j").isNull().alias("unmatched"))


def pixel_items(items: DataFrame, steps: DataFrame) -> DataFrame:
    """The pixel track: raw screenshots by question, the marker of the acted box, and the state without element tables."""
    own = items.where(F.col("question") != "ground").join(steps.select(F.col("id").alias("step_id"), "raw_before_img", "raw_after_img", "boxes_before", "chosen"), "step_id", "left")
    place = F.when(F.col("question") == "effect", F.col("chosen")).when(F.col("question") == "skip", F.col("candidate")).try_cast("int")
    marker = F.try_element_at("boxes_before", F.when(place > 0, place))
    images = F.when(F.col("question") == "effect", F.array("raw_before_img", "raw_after_img")).when(F.col("which") == "after", F.array("raw_after_img")).otherwise(F.array("raw_before_img"))
    kept = own.withColumn("marker", F.when(place.isNotNull(), marker)).withColumn("skipped", F.col("raw_before_img").isNull() | (place.isNotNull() & marker.isNull()))
    return kept.select(F.concat(F.lit("pixel:"), "id").alias("id"), "question", images.alias("images"), "marker", X.marked_state(F.col("state")).alias("state"), "label", "site", "skipped")


def operations(steps: DataFrame) -> DataFrame:
    """Operation rows: the elements with what can be done to each, recent actions, and the right operation."""
    parsed = F.transform("candidates", lambda c: F.struct(c["k"].alias("k"), X.candidate(c["text"]).alias("e")))
    rows = steps.where("error is null").withColumn("parsed", parsed)
    elements = F.transform("parsed", lambda c: F.struct(c["k"].cast("string").alias("index"), c["e"]["label"].alias("label"), F.when(c["e"]["typeable"], F.array(F.lit("CLICK"), F.lit("TYPE_TEXT"))).otherwise(F.array(F.lit("CLICK"))).alias("operations"), c["e"]["value"].alias("value")))
    recent = F.transform(F.slice("history", F.greatest(F.size("history") - 9, F.lit(1)), F.lit(10)), X.past_action)
    typeable = F.exists("parsed", lambda c: c["e"]["typeable"])
    target = X.first(F.filter("parsed", lambda c: c["k"].cast("string") == F.col("target_idx")))["e"]
    gold = F.when(F.col("labels.done_before") == 1, "DONE").when(target.isNull(), "BLOCKED").when((F.col("goal_kind") == "search") & target["typeable"], "TYPE_TEXT").otherwise("CLICK")
    return rows.select("id", F.to_json(F.struct(F.struct(F.col("before_url").alias("url"), F.lit("").alias("title"), F.lit("").alias("text")).alias("page"), elements.alias("elements"), recent.alias("recent_actions"))).alias("state"), typeable.alias("has_typeable"), gold.alias("gold"))


def schema_targets(items: DataFrame) -> DataFrame:
    """Typed targets of an item: last step, progress level, length of history, needs text and the target's tag."""
    last = F.col("step_index") == F.col("n_steps") - 1
    h = F.size("history")
    tag = F.lower(F.coalesce(F.col("target_tag"), X.bracket_tag(F.coalesce("target_repr", F.lit("")))))
    return items.select(
        "id",
        last.alias("final"),
        F.when(last, 4).otherwise(F.least(F.lit(3), F.floor((F.col("step_index") + 1) / F.col("n_steps") * 4))).cast("int").alias("progress"),
        F.when(h <= 2, h).when(h <= 4, 3).otherwise(4).alias("history_len"),
        (F.col("op") == "TYPE").alias("needs_text"),
        tag.alias("tag"),
    )


def soft_labels(rows: DataFrame, answers: DataFrame, temperature: float) -> DataFrame:
    """Hard targets moved aside, a teacher's distribution (id, keys, logits) at a temperature in their place."""
    p = N.softmax(F.col("logits"), temperature)
    soft = F.zip_with("keys", p, lambda k, x: F.struct(k.alias("key"), x.alias("p")))
    return rows.join(answers.select("id", "keys", "logits"), "id").select("*", soft.alias("soft"), F.array_max(p).alias("top")).drop("keys", "logits")


def hard_rows(rows: DataFrame, key: str, tops: str, threshold: float, share: float, seed: str) -> DataFrame:
    """Rows whose least certain question is under the threshold, and a share of the rest."""
    return rows.where((F.array_min(tops) < threshold) | (N.hash_unit(F.col(key), seed) < share))


def valid_generated(items: DataFrame) -> DataFrame:
    """Adds valid: the checks of generated items (state, questions as in schemas.ROW)."""
    size = F.size("questions")
    ids = F.transform("questions", lambda q: q["qid"])

    def good(q: Column) -> Column:
        n = F.size(q["criteria"])
        return q["qid"].isNotNull() & q["instructions"].isNotNull() & q["qtype"].isin("choice", "noul", "score") & F.when(q["qtype"] == "choice", n.between(2, 64) & F.forall(q["criteria"], lambda c: c["descr"].isNotNull())).when(q["qtype"] == "score", n.between(2, 9)).otherwise(True)

    ok = (F.length("state") >= 20) & size.between(1, 4) & (F.size(F.array_distinct(ids)) == size) & F.forall("questions", good)
    return items.withColumn("valid", F.coalesce(ok, F.lit(False)))


def with_partner(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Each row with a random other row's columns as b_..., by rank in hashed order within a shard of keys.

    Shards are as many as keep about PARTNERS rows in each; only the row of a table of one is its own partner.
    """
    shards = max(1, -(-rows.count() // PARTNERS))
    shard = F.floor(N.hash_unit(F.col(key), f"{seed}/s") * shards)
    ranked = rows.withColumn("_s", shard).withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(N.hash_order(F.col(key), seed), key)))
    sizes = ranked.groupBy("_s").agg(F.count("*").alias("_n"))
    other = ranked.select("_s", F.col("_r").alias("_next"), *[F.col(c).alias(f"b_{c}") for c in rows.columns])
    return ranked.join(sizes, "_s").withColumn("_next", F.col("_r") % F.col("_n") + 1).join(other, ["_s", "_next"]).drop("_s", "_r", "_n", "_next")


def merged_maps(a: Column, b: Column) -> Column:
    """Entries of two maps; of an equal key the right one's value."""
    a, b = (F.coalesce(F.map_entries(x), F.array()) for x in (a, b))
    keys = F.transform(b, lambda e: e["key"])
    return F.map_from_entries(F.concat(F.filter(a, lambda e: ~F.array_contains(keys, e["key"])), b))


def merged_questions(a: Column, b: Column) -> Column:
    """Questions of two rows, told apart by a prefix of their ids."""
    named = lambda qs, p: F.transform(qs, lambda q: q.withField("qid", F.concat(F.lit(p), q["qid"])))
    return F.concat(named(a, "a_"), named(b, "b_"))


def converted(rows: DataFrame, source: str, key: Column, state: Column, q: Column, target: Column, limit: int | None = None) -> DataFrame:
    """Rows of the engine from a source table: its key, state, question and hard target; without target none."""
    out = rows.select(F.concat(F.lit(f"{source}_"), key.cast("string")).alias("id"), F.lit(source).alias("source"), state.alias("state"), F.array(q).alias("questions"), target.cast("string").alias("target")).where("target is not null and target not in ('', '-1')")
    return out if limit is None else out.orderBy(N.hash_order(F.col("id"), source), "id").limit(limit)


def mixed(sources: list[tuple[DataFrame, int | None, int]], seed: str) -> DataFrame:
    """Union of sources (rows, how many or all, how often each)."""
    out = None
    for rows, n, times in sources:
        part = rows if n is None else rows.orderBy(N.hash_order(F.col("id"), seed), "id").limit(n)
        for _ in range(times):
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
