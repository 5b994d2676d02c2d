"""Generic structure of any text: title, equations, lists, tables, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip, text


def title(c: Column) -> Column:
    """First of the first 20 lines with 11 to 199 characters that is no header."""
    lines = F.transform(F.slice(F.split(text(c), "\n"), 1, 20), lambda x: strip(x))
    return F.get(F.filter(lines, lambda x: F.length(x).between(11, 199) & ~x.rlike(r"(?i)^(page|abstract|introduction|figure|table)")), 0)


def keywords(c: Column) -> Column:
    raw = F.regexp_extract(F.substring(text(c), 1, 2000), r"(?i)(?:keywords?|topics?)[\s:]*([^\n]+)", 1)
    parts = F.transform(F.split(raw, r"[,;]\s*"), lambda x: F.lower(strip(x)))
    return F.slice(F.filter(parts, lambda x: F.length(x).between(3, 49)), 1, 10)


def inline_equations(c: Column, most: int = 50) -> Column:
    """Contents between single dollars; pairs are taken from the left."""
    return F.slice(F.transform(F.regexp_extract_all(text(c), F.lit(r"\$([^$]+)\$"), 1), lambda x: strip(x)), 1, most)


def paragraphs(c: Column, most: int = 100) -> Column:
    """Blank-line chunks of 51 to 2999 characters that aren't headings or lists."""
    chunks = F.transform(F.split(text(c), "\n\n"), lambda x: strip(x))
    good = F.filter(chunks, lambda x: F.length(x).between(51, 2999) & ~x.rlike(r"(?i)^([0-9]+\.|[•\-*]|\$|Table|Figure|Algorithm)"))
    return F.slice(F.transform(good, lambda x: F.regexp_replace(x, r"\s+", " ")), 1, most)


def _runs(c: Column, item, least: int, most: int, kind=None) -> Column:
    """Runs of items among lines: a near-blank line, or another kind, ends one;
    longer lines that are no items don't."""
    empty = F.array().cast("array<struct<kind:string,items:array<string>>>")

    def step(acc: Column, raw: Column) -> Column:
        it = item(raw)
        k = kind(raw) if kind else F.lit("table")
        short = F.length(strip(raw)) < 3
        close = F.when(F.size(acc["cur"]) >= least, F.concat(acc["done"], F.array(F.struct(acc["kind"].alias("kind"), acc["cur"].alias("items"))))).otherwise(acc["done"])
        other = it.isNotNull() & (F.size(acc["cur"]) > 0) & (acc["kind"] != k)
        ends = it.isNull() & short & (F.size(acc["cur"]) > 0)
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(other | ends, close).otherwise(acc["done"]).alias("done"),
            F.when(other, F.array(it)).when(ends, none).when(it.isNotNull(), F.concat(acc["cur"], F.array(it))).otherwise(acc["cur"]).alias("cur"),
            F.when(it.isNotNull(), k).otherwise(acc["kind"]).alias("kind"),
        )

    start = F.struct(empty.alias("done"), F.array().cast("array<string>").alias("cur"), F.lit("").alias("kind"))
    last = lambda a: F.when(F.size(a["cur"]) >= least, F.concat(a["done"], F.array(F.struct(a["kind"].alias("kind"), a["cur"].alias("items"))))).otherwise(a["done"])
    return F.slice(F.aggregate(F.split(text(c), "\n"), start, step, last), 1, most)


def lists(c: Column) -> Column:
    """Array of (kind, items) of bullet and numbered lists, 30 at most."""
    mark = r"^\s*([•\-*+]|[0-9]+\.)\s+(.+)"
    item = lambda x: F.when(x.rlike(mark), strip(F.regexp_extract(x, mark, 2)))
    kind = lambda x: F.when(F.regexp_extract(x, mark, 1).rlike("^[0-9]"), "numbered").otherwise("bullet")
    return _runs(c, item, 1, 30, kind)


def tables(c: Column) -> Column:
    """Array of (kind, items): rows of piped or widely spaced cells, two or more, 20
    tables at most.  Cells of a row are joined by tabs."""

    def item(x: Column) -> Column:
        cells = F.filter(F.transform(F.split(strip(x), r"\s{2,}|\|"), lambda y: strip(y)), lambda y: y != "")
        looks = F.contains(x, F.lit("|")) | x.rlike(r"^[\s\w]+\s{2,}[\w\s]+")
        return F.when(looks & (F.length(strip(x)) > 10), let(cells, lambda y: F.when(F.size(y) > 1, F.array_join(y, "\t"))))

    return _runs(c, item, 2, 20)


def sections(c: Column) -> Column:
    """Array of (title, level) of numbered, capital and underlined headings."""

    def cut(ls: Column) -> Column:
        def head(x: Column, i: Column) -> Column:
            s = strip(x)
            number = r"^([0-9]+(?:\.[0-9]+)*)\s+([A-Z][^\n]+?)(?:\s*$|\s+\(|\.)"
            under = strip(F.coalesce(F.get(ls, i + 1), F.lit("")))
            capital = F.length(s).between(9, 149) & (s == F.upper(s)) & s.rlike(r"\p{Lu}") & ~s.endswith(":") & s.rlike(r"\S\s+\S") & ~s.rlike(r"^(?:\S{1,3}\s+)*\S{1,3}$")
            return (
                F.when(
                    s.rlike(number) & (F.length(F.regexp_extract(s, number, 2)) > 3),
                    F.struct(F.concat_ws(" ", F.regexp_extract(s, number, 1), F.regexp_extract(s, number, 2)).alias("title"), (F.regexp_count(x, F.lit(r"\.")) + 1).alias("level")),
                )
                .when(capital, F.struct(s.alias("title"), F.lit(1).alias("level")))
                .when(
                    under.rlike(r"^[=\-]{5,}$") & F.length(s).between(8, 149),
                    F.struct(s.alias("title"), F.when(F.contains(under, F.lit("=")), 1).otherwise(2).alias("level")),
                )
            )

        return F.filter(F.transform(ls, head), lambda h: h.isNotNull())

    return let(F.split(text(c), "\n"), cut)

