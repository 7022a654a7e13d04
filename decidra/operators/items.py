"""Items and rows in other shapes: round trips, submissions, payloads, descriptions, options and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra import schemas
from decidra.functions import numeric as N
from decidra.functions import text as X

from . import joins as J

#: The templates and states of the synthetic pages, and the least confidence of the chooser.
TEMPLATES = ("booking", "catalog", "help", "index", "search", "settings", "signup")
VARIANTS = ("base", "checked1", "disabled1", "done1", "filled1", "overlay1", "wrong1")
MOST_OPTIONS = 32


def to_rows(items: DataFrame, root: str = "") -> DataFrame:
    """Rows of items, the inverse of to_items but for what an item does not hold."""
    question = F.struct(F.col("question").alias("qid"), F.col("type").alias("qtype"), F.col("instructions").alias("instructions"), F.col("criteria").alias("criteria"))
    target = F.struct(F.col("question").alias("qid"), F.col("label").alias("hard"))
    images = F.transform("images", lambda x: absolute(x, root))
    return items.select("id", "state", images.alias("images"), F.array(question).alias("questions"), F.array(target).alias("targets"), F.struct("id", "step_id", "site", "candidate", "which").alias("meta"))


def absolute(path: Column, root: str) -> Column:
    """A relative path below root; an absolute one as it is."""
    return F.when(F.startswith(path, F.lit("/")) | F.lit(not root), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def to_submission(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions (id, p, choice, ms) of evaluation outputs: by their own id, without one by their place (column i)."""
    placed = items.select(F.col("i"), F.col("id").alias("_by_place"))
    return outputs.join(placed, "i", "left").select(F.coalesce("id", "_by_place").alias("id"), "p", "choice", "ms").where("id is not null")


def typed_target(qtype: Column, answer: Column) -> Column:
    """The hard target of an external answer: yes is 1, a score is a whole number, a choice its key."""
    return F.when(qtype == "noul", (F.lower(F.trim(answer)) == "yes").cast("int").cast("string")).when(qtype == "score", F.round(answer.try_cast("double")).cast("int").cast("string")).otherwise(answer)


def payload(questions: Column) -> Column:
    """Questions as an object by id, as a request to a judge has them."""
    return F.to_json(F.map_from_entries(F.transform(questions, lambda q: F.struct(q["qid"].alias("key"), F.struct(q["qtype"].alias("type"), q["instructions"].alias("instructions"), q["criteria"].alias("criteria")).alias("value")))))


def text_view(question: Column, which: Column, state: Column, before: Column, after: Column) -> Column:
    """What a judge without screenshots reads: both tables for effect, else the one of the row's side."""
    table = F.when(question == "effect", F.concat(F.lit("Before:\n"), before, F.lit("\nAfter:\n"), after)).when(which == "after", after).otherwise(before)
    return F.concat(state, F.lit("Elements:\n"), table)


def described(tag: Column, attributes: dict[str, Column]) -> Column:
    """`tag name="..." ...`: attributes that are there, cut at 40 characters."""
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f'{k}="'), F.left(v, F.lit(40)), F.lit('"'))) for k, v in attributes.items()]
    return F.concat_ws(" ", tag, *parts)


def trimmed_boxes(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: F.struct(b["tag"].alias("tag"), b["type"].alias("type"), F.left(b["text"], F.lit(80)).alias("text"), *[F.round(b[c]).alias(c) for c in "xywh"]))


def target_options(candidates: Column, typeable_only: bool) -> Column:
    """Criteria of a target question: elements by key, only those that take typing where asked for."""
    parsed = F.transform(candidates, lambda c: F.struct(c["k"].cast("string").alias("k"), X.candidate(c["text"]).alias("e")))
    kept = F.filter(parsed, lambda c: c["e"]["typeable"]) if typeable_only else parsed
    return F.transform(kept, lambda c: F.struct(c["k"].alias("key"), F.to_json(F.struct(F.concat(F.lit("["), c["k"], F.lit("] "), c["e"]["label"]).alias("element"), F.coalesce(c["e"]["value"], F.lit("")).alias("current_value"))).alias("descr")))


def contained(x: Column, y: Column, w: Column, h: Column, top: Column, width: float, height: float, least: float = 6.0) -> Column:
    """Whether a box is large enough and lies in the view that begins at top."""
    return (w >= least) & (h >= least) & (x >= 0) & (x + w <= width) & (y >= top) & (y + h <= top + height)


def choice_items(near: DataFrame, by: str, seed: str, none_share: float) -> DataFrame:
    """Items of a row (by) and its negatives (other), in hashed order; for a share of them gold is none."""
    groups = near.groupBy(by).agg(F.collect_list("other").alias("others"))
    lost = N.hash_unit(F.col(by), f"{seed}/none") < none_share
    options = F.when(lost, F.col("others")).otherwise(F.concat("others", F.array(by)))
    mixed = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(by).cast("string"), o.cast("string"))).alias("h"), o.alias("o")))), lambda x: x["o"])
    place = F.array_position(mixed, F.col(by))
    return groups.select(by, mixed.alias("options"), F.when(lost, "none").otherwise(place.cast("string")).alias("gold"))


def confusable(rows: DataFrame, keys: list[str], key: str, role: str, text: str, k: int, seed: str) -> DataFrame:
    """The k elements of an image that are easiest to take for the target: same role first, then length, with a hashed jitter.

    Others of the same role are looked for first; rows that have fewer than k of them fill up with other roles. The jitter
    differs from pair to pair, so all rows of a length and role have to be looked at; only pairs that may be among the k go on.
    """
    jitter = N.hash_unit(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")), seed) * 3
    own = rows.select(*keys, key, F.col(role).alias("_role"), F.length(text).alias("_length"))
    alike = J.nearest(own, [*keys, "_role"], key, {"_length": 1.0}, k, jitter, most=3.0)
    few = alike.groupBy(key).agg(F.count("*").alias("_n"))
    short = own.join(few, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < k)
    more = J.nearest(own, keys, key, {"_length": 1.0}, k, jitter, others=("_role", short.select(key)), most=3.0).join(short.select(key, "_n"), key)
    return alike.unionByName(more.where(F.col("rank") + F.col("_n") <= k).withColumn("rank", (F.col("rank") + F.col("_n")).cast("int")).drop("_n"))


def augmented(criteria: Column, gold: Column, key: Column, pool: Column, size: int, seed: str) -> Column:
    """Options reduced or filled up to size: gold stays, others are dropped by hash, then distractors of a pool are added."""
    ranked = lambda xs, s: F.array_sort(F.transform(xs, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(s), key.cast("string"), x)).alias("h"), x.alias("x"))))
    others = F.transform(F.slice(ranked(F.filter(criteria, lambda c: c != gold), seed), 1, size - 1), lambda r: r["x"])
    fresh = F.filter(pool, lambda p: ~F.array_contains(criteria, p))
    more = F.transform(F.slice(ranked(fresh, f"{seed}+"), F.lit(1), F.greatest(F.lit(size - 1) - F.size(others), F.lit(0))), lambda r: r["x"])
    return F.transform(ranked(F.concat(F.array(gold), others, more), f"{seed}!"), lambda r: r["x"])


def answers(logits: DataFrame, noul_temperature: float, temperature: float) -> DataFrame:
    """Answers of a server from its logits (qtype, keys, z): probability, confidence, choice and expected level."""
    p = F.when(F.col("qtype") == "noul", F.array(1 / (1 + F.exp(-F.element_at("z", 1) / noul_temperature)))).otherwise(N.softmax(F.col("z"), temperature))
    rows = logits.withColumn("p", p)
    choice = F.when(F.col("qtype") == "noul", F.when(F.element_at("p", 1) > 0.5, "yes").otherwise("no")).otherwise(F.element_at("keys", (N.arg_max(F.col("p")) + 1).cast("int")))
    conf = F.when(F.col("qtype") == "noul", N.yes_confidence(F.element_at("p", 1))).otherwise(N.choice_confidence(F.col("p")))
    return rows.select("*", choice.alias("choice"), conf.alias("conf"), F.when(F.col("qtype") == "score", N.expected_level(F.col("p"))).alias("level"))


def chosen_actions(requests: DataFrame, least: float) -> DataFrame:
    """The chooser's contract: unique ids, 32 at most, else an error; an unsure choice abstains, one of an unknown id asks again."""
    ids = F.col("ids")
    error = F.when(F.size(ids) == 0, "no options").when(F.size(ids) > MOST_OPTIONS, "too many options").when(F.size(F.array_distinct(ids)) < F.size(ids), "ids are not unique")
    action = F.when(error.isNotNull(), "error").when(F.col("conf") < least, "abstain").when(~F.array_contains(ids, F.col("choice")), "reobserve").otherwise("act")
    return requests.select("*", action.alias("action"), error.alias("error"))


def permutation_sensitivity(plain: DataFrame, reversed_: DataFrame) -> DataFrame:
    """Mean change of the gold option's probability when options come in reverse order."""
    both = plain.select("id", "gold", F.col("p").alias("a")).join(reversed_.select("id", F.reverse("p").alias("b")), "id")
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.get("a", F.col("gold")) - F.get("b", F.col("gold")))).alias("sensitivity"))


def page_checks(pages: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Independent checks of an end state; ok where all hold."""
    names = list(checks)
    out = pages.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    return out.withColumn("ok", F.forall(F.array(*names), lambda x: x))


def synthetic_pages(base: DataFrame, prefix: Column | str = "") -> DataFrame:
    """Every row of base with all templates and states, and their addresses behind a prefix."""
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    rows = base.select(*[c for c in base.columns if c != "url"], start.alias("_start"), F.explode(F.array(*map(F.lit, TEMPLATES))).alias("template"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant"))
    return rows.withColumn("url", F.concat("_start", "template", F.lit("__"), "variant", F.lit(".html"))).drop("_start")


def empty_criteria() -> Column:
    return F.array().cast(schemas.CRITERIA)


def stay_dates(start: Column, days: int) -> Column:
    """A date some days on, spelt out."""
    return F.date_format(F.date_add(start, days), "EEEE, MMMM d")
