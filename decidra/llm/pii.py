"""Personal data and the terms that reveal it, with DataFrame functions only.

Base spans come from four patterns. Then co-occurrence over the whole corpus tells how strongly a term reveals a
protected entity (an e-mail address, phone, card or IP number as found): for a term t among the neighbours of e,

    disclosure(t, e) = log2( P(e | t) / P(e) ) = log2( n(t, e) * N / (n(t) * n(e)) )

with document counts: n(t, e) documents with t next to e, n(t) with t anywhere, n(e) with e, N all. The information of
e itself is log2( N / n(e) ), so a frequent entity has less to disclose. A term is telling if for some entity its
disclosure is at least `threshold` of the entity's information, P(e | t) at least `posterior`, n(t, e) at least
`support`, and n(t, e) * disclosure at least `evidence` bits, so that chance doesn't explain it. All occurrences
of a telling term in all texts are spans of kind term (but those that a base span covers), which are generalised or
removed with the rest.

Neighbours of an entity are the `NEIGHBOURS` words and entities before and after it. Counts are partial sums before each
shuffle. Places in a text come from running sums in blocks of the square root of their number, and neighbours from one
sorted list of words and spans, so a text of very many entities costs little more than a plain one of its size.

Defined cases: null counts as empty; rows with the same doc_id are separate rows; equal places of two kinds both count.
An empty table gives no rows; a very long text is one row of native expressions; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.arrays import let, running
from .common import written

KINDS = ("email", "ip", "card", "phone", "term")
TERM = len(KINDS) - 1
# A match can begin where the last one ended or where no character of its first run stands before: other places in a
# run can't match when its beginning doesn't. Possessive groups keep the matcher off the stack.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of digits with single separators; only those of 14 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HINT = {"email": "@", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words and entities on each side of an entity that count as its neighbours.
NEIGHBOURS = 8
THRESHOLD, POSTERIOR, SUPPORT, EVIDENCE = 0.75, 0.5, 2, 12.0
#: Telling terms up to which they are sent to all executors; beyond, they are joined by a shuffle.
FEW_TERMS = 200_000
#: Code points of the pieces in which a text is rewritten.
PIECE = 1024

SPAN = "array<struct<start:int,end:int,rank:int,value:string>>"


def _luhn(digits: Column) -> Column:
    """Digits from the right: every second one doubled, with 9 taken off where that is over 9."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _test(kind: str):
    return lambda span: _holds(kind, span["value"])


def plain_lower(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def found(text: Column, pattern: str, rank: int) -> Column:
    """Spans of all matches: the texts between them, split off by the same pattern, give their places."""

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(matches))
        ends = running(F.zip_with(gaps, matches, lambda gap, v: gap + F.length(v)), lambda a, b: a + b)
        return F.zip_with(ends, matches, lambda end, v: F.struct((end - F.length(v)).alias("start"), end.alias("end"), F.lit(rank).alias("rank"), v.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds by start, then kind; 0-based code points, end exclusive."""
    none = F.array().cast(SPAN)
    every = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        hint = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else text.rlike(pattern)
        every.append(F.when(hint, F.filter(found(text, pattern, rank), _test(kind))).otherwise(none))
    return by_place(F.concat(*every))


def by_place(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["value"].alias("value"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["value"].alias("value")))


def _terms(text: Column) -> Column:
    return F.filter(F.split(plain_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def items(text: Column, base: Column) -> Column:
    """Base spans and the words that none of them covers, by place; words in lower case, of rank TERM."""
    far = F.lit((1 << 31) - 1)

    def clear(every: Column) -> Column:
        # Ends of the spans so far, and from behind how far the next one's start is from the far end.
        reach = running(F.transform(every, lambda s: F.when(s["rank"] == TERM, 0).otherwise(s["end"])), F.greatest)
        ahead = F.reverse(running(F.transform(F.reverse(every), lambda s: F.when(s["rank"] == TERM, 0).otherwise(far - s["start"])), F.greatest))
        sides = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), (far - a).alias("ahead")))
        marked = F.zip_with(every, sides, lambda s, m: F.struct(s.alias("s"), ((s["rank"] < TERM) | ((m["reach"] <= s["start"]) & (m["ahead"] >= s["end"]))).alias("clear")))
        return F.transform(F.filter(marked, lambda x: x["clear"]), lambda x: x["s"])

    return let(by_place(F.concat(base, found(plain_lower(text), WORD, TERM))), clear)


def neighbours(items: Column, n: int) -> Column:
    """(term, entity) for the words among the n items before and after each span."""

    def near(every: Column) -> Column:
        spots = F.filter(F.transform(every, lambda s, i: F.struct(s["rank"].alias("rank"), s["value"].alias("value"), i.alias("i"))), lambda s: s["rank"] < TERM)
        words = F.transform(spots, lambda e: F.transform(F.filter(F.slice(every, F.greatest(e["i"] - n, F.lit(0)) + 1, F.least(e["i"], F.lit(n)) + n + 1), lambda w: w["rank"] == TERM), lambda w: F.struct(w["value"].alias("term"), e["value"].alias("entity"))))
        return F.flatten(words)

    return let(items, near)


def disclosures(seen: DataFrame, frequencies: DataFrame, entities: DataFrame, total: int, threshold: float, posterior: float, support: int, evidence: float) -> DataFrame:
    """(term, entity, bits) for the pairs that exceed the thresholds; seen has (_rid, term, entity) once for each document."""
    pairs = seen.groupBy("term", "entity").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    rated = pairs.join(frequencies, "term").join(entities, "entity")
    bits = F.log2(F.col("both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    rated = rated.select("term", "entity", "both", F.round(bits, 9).alias("bits"), F.round(threshold * own, 9).alias("least"), (F.col("both") / F.col("n_term")).alias("share"))
    return rated.where((F.col("bits") >= F.col("least")) & (F.col("share") >= posterior) & (F.col("both") * F.col("bits") >= evidence)).select("term", "entity", "bits")


def spans(docs: DataFrame, threshold: float = THRESHOLD, posterior: float = POSTERIOR, support: int = SUPPORT, evidence: float = EVIDENCE, near: int = NEIGHBOURS) -> DataFrame:
    """_rid, doc_id, base and spans of every row of docs (_rid, doc_id, text); spans holds base and the terms."""
    text = docs.select("_rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = text.select("_rid", "doc_id", "text", base_spans(F.col("text")).alias("base"))
    around = F.when(F.size("base") > 0, neighbours(items(F.col("text"), F.col("base")), near))
    rows = written(base.select("_rid", "doc_id", "base", around.alias("around")), "pii")
    seen = rows.select("_rid", F.explode("around").alias("x")).select("_rid", "x.term", "x.entity").distinct()
    entities = rows.select(F.explode(F.array_distinct(F.transform("base", lambda s: s["value"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = text.select("_rid", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    frequencies = terms.groupBy("term").agg(F.count("*").alias("n_term"))
    telling = written(disclosures(seen, frequencies, entities, rows.count(), threshold, posterior, support, evidence).select("term").distinct(), "telling")
    few = F.broadcast(telling) if telling.count() <= FEW_TERMS else telling.hint("merge")
    hits = written(terms.join(few, "term"), "hits")
    # Words of the texts with telling terms once more, with their places.
    wanted = rows.select("_rid", "base").join(hits.select("_rid").distinct(), "_rid", "left_semi")
    words = text.select("_rid", "text").join(wanted, "_rid").select("_rid", F.explode(items(F.col("text"), F.col("base"))).alias("s")).where(F.col("s.rank") == TERM)
    places = words.select("_rid", "s", F.col("s.value").alias("term")).join(hits, ["_rid", "term"]).groupBy("_rid").agg(F.collect_list("s").alias("terms"))
    return rows.join(written(places, "places"), "_rid", "left").select("_rid", "doc_id", "base", by_place(F.concat("base", F.coalesce("terms", F.array().cast(SPAN)))).alias("spans"))


def count(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column, generalise: bool = True) -> Column:
    """The text with each covered stretch replaced by the kind of its first span in brackets, or removed.

    The text is taken in pieces of PIECE code points, since a place in a long string is found by counting from its start.
    """
    kinds = F.array(*[F.lit(k.upper()) for k in KINDS])
    mark = lambda s: F.concat(F.lit("["), F.element_at(kinds, s["rank"] + 1), F.lit("]")) if generalise else F.lit("")

    def part(pieces: Column, low: Column, high: Column) -> Column:
        """Code points low .. high of the text, high excluded."""
        first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
        at = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        apart = F.concat(F.substring(at(first), low % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), high % PIECE))
        return F.when(high <= low, "").when(first == last, F.substring(at(first), low % PIECE + 1, high - low)).otherwise(apart)

    def rewritten(pieces: Column) -> Column:
        def covered(before: Column) -> Column:
            sides = F.zip_with(spans, F.slice(before, 1, F.size(spans)), lambda s, b: F.struct(s["start"].alias("start"), b.alias("from"), s["rank"].alias("rank")))
            kept = F.transform(sides, lambda s: F.when(s["start"] >= s["from"], F.concat(part(pieces, s["from"], s["start"]), mark(s))).otherwise(""))
            return F.concat(F.array_join(kept, ""), part(pieces, F.element_at(before, -1), F.length(text)))

        return let(F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["end"]), F.greatest)), covered)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), rewritten))


def sanitised_documents(docs: DataFrame, found: DataFrame, generalise: bool = True) -> DataFrame:
    """_rid, doc_id, base, spans and the sanitised text of docs (_rid, text) and their spans()."""
    texts = docs.select("_rid", F.coalesce("text", F.lit("")).alias("text"))
    return found.join(texts, "_rid").select("_rid", "doc_id", "base", "spans", sanitised(F.col("text"), F.col("spans"), generalise).alias("text"))
