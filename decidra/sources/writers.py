"""Sinks: JSON lines by split, resumable appends, guarded overwrites, reports and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a report, which become one text.
MOST_LINES = 10_000


def json_lines(rows: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Null fields are left out; with by a folder per value."""
    writer = rows.write.mode(mode).option("ignoreNullFields", True)
    (writer.partitionBy(by) if by else writer).json(path)


def manifest(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Files to copy: one source for each target, the smallest."""
    return rows.groupBy(target).agg(F.min(source).alias(source))


def newest(checkpoints: DataFrame, keep: int, step: str = "step") -> DataFrame:
    """Checkpoints to delete: all but the last by number of step."""
    kept = checkpoints.orderBy(F.desc(step)).limit(keep)
    return checkpoints.join(kept.select(step), step, "left_anti")


def moved(images: Column, old: str, new: str) -> Column:
    """A path prefix replaced in an array of paths."""
    return F.transform(images, lambda x: F.when(x.startswith(old), F.concat(F.lit(new), F.substr(x, F.lit(len(old) + 1)))).otherwise(x))


def report_json(report: DataFrame) -> DataFrame:
    """One JSON text of a report in the order of its first column; more than MOST_LINES rows are an error."""
    if report.limit(MOST_LINES + 1).count() > MOST_LINES:
        raise ValueError(f"a report must have at most {MOST_LINES} rows")
    rows = report.select(F.struct(*report.columns).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select(F.to_json("rows").alias("json"))


def cell(acc: Column, positive: Column, negative: Column, n: Column) -> Column:
    """`acc (pos/neg) n=`; a dash where there is none."""
    three = lambda x: F.format_string("%.3f", x)
    split = F.when(positive.isNotNull() | negative.isNotNull(), F.concat(F.lit(" ("), F.coalesce(three(positive), F.lit("-")), F.lit("/"), F.coalesce(three(negative), F.lit("-")), F.lit(")"))).otherwise("")
    return F.when(acc.isNull(), "-").otherwise(F.concat(three(acc), split, F.lit(" n="), n.cast("string")))


def fixed_width(columns: dict[str, int]) -> Column:
    """Columns as a line of a table: names with widths, right-aligned; negative widths are left-aligned."""
    return F.concat_ws(" ", *[(F.lpad if w > 0 else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("-")), abs(w), " ") for c, w in columns.items()])


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def audit_page(items: DataFrame, order: str) -> DataFrame:
    """A page for human audit: a table row per item, texts escaped; for the few items of an audit."""
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in items.columns])
    rows = items.select(F.struct(order, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    head = "".join(f"<th>{c}</th>" for c in items.columns)
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "\n")
    return rows.select(F.concat(F.lit(f"<!DOCTYPE html><meta charset=utf-8><table><tr>{head}</tr>\n"), body, F.lit("\n</table>")).alias("html"))
