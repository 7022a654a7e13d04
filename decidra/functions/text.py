"""Texts, URLs and arrays of the row model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of candidate texts and of history entries, and the names of search parameters.
CANDIDATE = r"^element (\d+): (\w+)(?: (\w+))? '(.*?)'(?: value='(.*?)')?$"
HISTORY = r"^(\w+) on (.*?)(?: typed '(.*)')?$"
VALUE = r" value='([^']*)'$"
TYPEABLE_TAGS = ("input", "textarea", "searchbox", "combobox")
PLAIN_TYPES = ("submit", "button", "checkbox", "radio")
SEARCH_PARAMETERS = "q|query|search|search_query|s|k|keyword|keywords|term|text|p|wd|find|searchterm"


def item_id(step: Column, question: Column, candidate: Column, which: Column) -> Column:
    return F.concat_ws(":", step, question, F.coalesce(candidate, F.lit("")), F.coalesce(which, F.lit("")))


def rendered_state(goal: Column, history: Column) -> Column:
    lines = F.when(F.size(history) > 0, F.array_join(F.transform(history, lambda h: F.concat(F.lit("  - "), h)), "\n")).otherwise("  (none)")
    return F.concat(F.lit("Task: "), goal, F.lit("\nActions already taken:\n"), lines, F.lit("\n"))


def acted(action: Column, target: Column, typed: Column) -> Column:
    """A history entry."""
    return F.concat(action, F.lit(" on "), F.left(F.coalesce(target, F.lit("?")), F.lit(40)), F.when(F.coalesce(typed, F.lit("")) != "", F.concat(F.lit(" typed '"), typed, F.lit("'"))).otherwise(""))


def candidate(text: Column) -> Column:
    """Fields of a candidate text; a text outside the grammar is all label and takes no typing."""
    text = F.trim(text)
    matched = text.rlike(CANDIDATE)
    group = lambda k: F.regexp_extract(text, CANDIDATE, k)
    typeable = group(2).isin(*TYPEABLE_TAGS) & ~group(3).isin(*PLAIN_TYPES)
    return F.struct(
        F.when(matched, group(1).cast("int")).alias("index"),
        F.when(matched, group(2)).alias("tag"),
        F.when(matched, F.nullif(group(3), F.lit(""))).alias("type"),
        F.when(matched, group(4)).otherwise(text).alias("label"),
        F.when(matched & text.rlike(VALUE), group(5)).alias("value"),
        (matched & typeable).alias("typeable"),
    )


def field_value(text: Column) -> Column:
    return F.regexp_extract(text, VALUE, 1)


def past_action(text: Column) -> Column:
    matched = text.rlike(HISTORY)
    return F.struct(F.when(matched, F.regexp_extract(text, HISTORY, 2)).otherwise(text).alias("action"), F.when(matched, F.regexp_extract(text, HISTORY, 1)).alias("kind"), F.when(matched & text.rlike(" typed '.*'$"), F.regexp_extract(text, HISTORY, 3)).alias("text"))


def squeezed(text: Column, size: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return out if size is None else F.left(out, F.lit(size))


def first_number(text: Column, default: float = 0.5) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double"), F.lit(default))


def json_in(text: Column, schema: str) -> Column:
    """The widest braces of a text, read as JSON."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def vote(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), r"\b(none|\d+)\b", 1), F.lit(""))


def bracket_tag(text: Column) -> Column:
    return F.regexp_extract(text, r"^\[(\w+)\]", 1)


def marked_state(state: Column) -> Column:
    """The last action told by the marker instead of the element."""
    return F.regexp_replace(state, r"Last action: (\w+) on [^\n]*", "Last action: $1 at the red marker")


def without_suffix(text: Column, suffix: str) -> Column:
    return F.rtrim(text, F.lit(suffix))


def letters(n: Column) -> Column:
    """Option letters from A on."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(i + 65))


def prompt(instructions: Column, options: Column) -> Column:
    """Instructions and lettered options, a line each."""
    lines = F.zip_with(letters(F.size(options)), options, lambda a, b: F.concat(a, F.lit(". "), b))
    return F.concat(instructions, F.lit("\n"), F.array_join(lines, "\n"))


def shortened(text: Column, fractions: tuple[float, ...], words: int) -> Column:
    """The longest of the fractions of a text's words that has at most so many words; else the shortest."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cut = lambda f: F.slice(parts, 1, F.floor(F.size(parts) * F.lit(f)).cast("int"))
    out = F.when(F.size(parts) <= words, F.array_join(parts, " "))
    for f in fractions:
        out = out.when(F.size(cut(f)) <= words, F.array_join(cut(f), " "))
    return out.otherwise(F.array_join(cut(fractions[-1]), " "))


# ---- URLs


def decoded(url: Column) -> Column:
    """Percent-decoded with plus as blank, in lower case; a malformed URL is left as it is."""
    return F.lower(F.coalesce(F.try_url_decode(url), F.replace(url, F.lit("+"), F.lit(" "))))


def normalised(url: Column) -> Column:
    return F.rtrim(F.substring_index(decoded(url), "#", 1), F.lit("/"))


def quoted(text: Column) -> Column:
    """The text as a regular expression that matches itself."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-&#~ ])", r"\\$1")


def search_done(url: Column, query: Column) -> Column:
    """Whether the query was submitted: as a search parameter, a /search path segment, or the title it led to."""
    u, q = decoded(url), F.lower(query)
    parameter = F.regexp_like(u, F.concat(F.lit(rf"[?&#](?:{SEARCH_PARAMETERS})=[^&#]*"), quoted(q)))
    segment = F.regexp_like(u, F.concat(F.lit(r"/search[^?]*/"), quoted(q), F.lit(r"(?:[/?&#]|$)")))
    path = F.rtrim(F.substring_index(F.substring_index(u, "?", 1), "#", 1), F.lit("/"))
    return parameter | segment | (F.replace(F.substring_index(path, "/", -1), F.lit("_"), F.lit(" ")) == q)


def follow_done(url: Column, href: Column, start: Column) -> Column:
    """Whether a followed link's page is open."""
    u, h = normalised(url), normalised(href)
    return (u != normalised(start)) & (F.contains(u, h) | F.endswith(u, h))


def success(text: Column, rule: Column) -> Column:
    """A rule is a text to be there, or with a leading mark not to be there."""
    negated = F.startswith(rule, F.lit("!"))
    return F.when(negated, ~F.contains(text, F.substr(rule, F.lit(2)))).otherwise(F.contains(text, rule))


# ---- Arrays


def first(values: Column) -> Column:
    """The first element, null where there is none."""
    return F.get(values, F.lit(0))


def keys_of(criteria: Column) -> Column:
    return F.transform(criteria, lambda c: c["key"])


def soft_vector(keys: Column, soft: Column) -> Column:
    """Probabilities in the order of the keys; a missing key has 0."""
    return F.transform(keys, lambda k: F.coalesce(first(F.filter(soft, lambda s: s["key"] == k))["p"], F.lit(0.0)))


def padded(values: Column, size: int, pad: Column) -> Column:
    return F.slice(F.concat(values, F.array_repeat(pad, size)), 1, size)


def pair_places(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def url_safe_text(text: Column) -> Column:
    """URL-safe base64 with or without its padding, as text."""
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(plain) % 4, F.lit(4))))).cast("string")


def signature(elements: Column) -> Column:
    return F.md5(F.to_json(elements))


def numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))


def digit_pieces(text: Column) -> Column:
    """Number of pieces where each digit stands alone and what is between digits is one piece."""
    return F.regexp_count(text, F.lit(r"\d")) + F.regexp_count(text, F.lit(r"\D+"))


def byte_codes(text: Column, n: int) -> Column:
    """The first n bytes of a text in UTF-8, with zeros after a shorter one."""
    digits = F.rpad(F.substring(F.hex(F.encode(F.left(F.coalesce(text, F.lit("")), F.lit(n)), "UTF-8")), 1, 2 * n), 2 * n, "0")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
