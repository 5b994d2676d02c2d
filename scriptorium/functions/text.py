"""Text functions over columns: cleaning, escaping, line arrays."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: lambdas re-evaluate what they capture."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(column) -> Column:
    """The column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space to one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cleanup(c: Column) -> Column:
    """Collapse, with replacement characters as hyphens and plain apostrophes."""
    return collapse(F.translate(c, "�’", "-'"))


def n_words(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.when(strip(c) == "", F.lit(0)).otherwise(F.size(F.split(collapse(c), " ")))


def words(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def contains_any(c: Column, needles: list[str]) -> Column:
    return c.rlike("|".join(re.escape(n) for n in needles))  # one pass, one evaluation


def count_present(c: Column, needles: list[str]) -> Column:
    """How many of the needles occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(n)).cast("int") for n in needles])


def split_list(c: Column, separators: str) -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(c, separators), lambda x: strip(x)), lambda x: x != "")


def lines_of(c: Column) -> Column:
    """Lines, whatever the line ends."""
    return F.split(F.regexp_replace(text(c), r"\r\n|\r", "\n"), "\n")


def repeated(values: Column, least_length: int) -> Column:
    """The distinct values longer than ``least_length`` that occur twice or more,
    ascending.  Sorts once instead of comparing all pairs."""
    return let(
        F.array_sort(F.filter(values, lambda x: F.length(x) > least_length)),
        lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))),
    )


def normalize_spacing(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def repair_hyphenation(c: Column) -> Column:
    return F.regexp_replace(c, r"(\w)-\s+([a-z])", "$1$2")


def normalize_symbols(c: Column) -> Column:
    return F.translate(c, "�‘’“”•", "-''\"\"")


def section_boundaries(c: Column) -> Column:
    """A roman heading in capitals starts a line of its own."""
    return F.regexp_replace(c, r"\s+((?:I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)\.\s+[A-Z][A-Z\s\-]+)", "\n$1")


def drop_reference_tail(c: Column) -> Column:
    for tail in ("IEEE INFOCOM", "Authorized licensed use limited to:"):
        c = F.regexp_replace(c, rf"(?is)References\s+{tail}.*", "References")
    return c


def remove_all(c: Column, patterns: list[str], flags: str = "(?is)") -> Column:
    for p in patterns:
        c = F.regexp_replace(c, flags + p, " ")
    return c


def strip_reference_noise(c: Column) -> Column:
    """Cut off lists of figures or tables and appendices behind a bibliography."""
    for p in ("LIST OF FIGURES.*", "LIST OF TABLES.*", "APPENDI(?:X|CES).*"):
        c = F.regexp_replace(c, "(?is)" + p, "")
    return strip(c)


def escape_latex(c: Column) -> Column:
    """Escape what LaTeX takes specially, unless a backslash stands before it."""
    c = F.regexp_replace(c, r"(?<!\\)([&%$#_])", r"\\$1")
    c = F.regexp_replace(c, r"(?<!\\)~", r"\\~{}")
    return F.regexp_replace(c, r"(?<!\\)\^", r"\\^{}")


def normalise_artifact(c: Column) -> Column:
    """Ligatures, dashes, signs and gamma of extracted text in plain letters."""
    for a, b in (("ï¬", "fi"), ("â€“", "-"), ("â€”", "-"), ("âˆ’", "-"), ("−", "-"), ("Ã—", "x"), ("×", "x"), ("Î³", "gamma"), ("γ", "gamma")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(strip(c), r"\s+", " ")


def heading(c: Column) -> Column:
    """A heading without its number, every word capitalised."""
    c = strip(F.regexp_replace(c, r"^[IVX]+\.\s*", ""))
    c = strip(F.regexp_replace(c, r"^\d+(?:\.\d+)?\.?\s*", ""))
    return F.initcap(collapse(c))


def repair_drop_cap(c: Column) -> Column:
    """``D IGITAL x`` to ``Digital x`` at the start of a text."""
    joined = F.regexp_replace(strip(c), r"^([A-Z])\s+([A-Z]{2,}\b)", "$1$2")
    cap = F.regexp_extract(joined, r"^([A-Z]{3,})(?=\s+[a-z])", 1)
    return F.when(cap == "", joined).otherwise(F.concat(F.initcap(cap), F.expr("''"), F.substr(joined, F.length(cap) + 1)))
