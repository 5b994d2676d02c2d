"""LaTeX manuscripts to records: one projection over the whole text of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import let, split_list, strip


def first(c: Column, pattern: str) -> Column:
    """First match of group 1, trimmed; empty where there is none."""
    return strip(F.regexp_extract(c, "(?s)" + pattern, 1))


def title(c: Column) -> Column:
    found = first(c, r"\\title\{(.+?)\}")
    return F.when(found == "", "Untitled").otherwise(found)


def authors(c: Column) -> Column:
    """Parts of the first author command, up to its first closing brace."""
    return split_list(first(c, r"\\author\{(.+?)\}"), r"\\and|,")


def abstract(c: Column) -> Column:
    return first(c, r"\\begin\{abstract\}(.*?)\\end\{abstract\}")


def keywords(c: Column) -> Column:
    """Of the ACM command if present, else of the IEEE environment."""
    command = F.regexp_extract(c, r"(?s)\\keywords\{(.+?)\}", 1)
    block = F.regexp_extract(c, r"(?s)\\begin\{IEEEkeywords\}(.*?)\\end\{IEEEkeywords\}", 1)
    return split_list(F.replace(F.when(command != "", command).otherwise(block), F.lit("\n"), F.lit(" ")), "[,;]")


def acknowledgments(c: Column) -> Column:
    block = first(c, r"\\begin\{acks\}(.*?)\\end\{acks\}")
    starred = first(c, r"\\section\*\{[Aa]cknowledg(?:e)?ments\}(.*?)(?=\\section|\\bibliography|\\end\{document\})")
    return F.when(block != "", block).otherwise(starred)


def ccs_concepts(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\\ccsdesc(?:\[[^\]]+\])?\{([^}]+)\}"), 1)
    return F.filter(F.transform(found, lambda x: strip(x)), lambda x: x != "")


def ccsxml(c: Column) -> Column:
    return first(c, r"\\begin\{CCSXML\}(.*?)\\end\{CCSXML\}")


def preamble(c: Column) -> Column:
    """What stands before the document begins; empty without a beginning."""
    mark = r"\begin{document}"
    return F.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, 1)).otherwise("")


def source_packages(pre: Column) -> Column:
    """Distinct packages of a preamble but for those every template brings."""
    lists = F.regexp_extract_all(pre, F.lit(r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}"), 1)
    names = F.flatten(F.transform(lists, lambda x: split_list(x, ",")))
    return F.array_except(F.array_distinct(names), F.array(*[F.lit(p) for p in K.SKIP_PACKAGES]))


def tikz_libraries(pre: Column) -> Column:
    found = [F.regexp_extract_all(pre, F.lit(r"(\\use%s\{[^}]+\})" % kind), 1) for kind in ("tikzlibrary", "pgfplotslibrary")]
    return F.array_distinct(F.concat(*found))


def sections(c: Column) -> Column:
    """Array of (ord, title, content): a body runs to the next section command and
    is cut where the bibliography, an appendix or the document's end begins."""
    parts = F.slice(F.split(c, r"(?=\\section\{[^\n]+?\})"), 2, 1_000_000)
    parts = F.when(c.rlike(r"^\\section\{"), F.split(c, r"(?=\\section\{[^\n]+?\})")).otherwise(parts)

    def one(p: Column, i: Column) -> Column:
        head = F.regexp_extract(p, r"^\\section\{(.+?)\}", 0)
        body = F.element_at(F.split(F.substr(p, F.length(head) + 1), K.SECTION_END, 2), 1)
        return F.struct(
            i.alias("ord"), strip(F.regexp_extract(p, r"^\\section\{(.+?)\}", 1)).alias("title"), strip(body).alias("content")
        )

    return F.transform(parts, one)


def parse(sources: DataFrame, column: str = "latex") -> DataFrame:
    """Add the record's fields to ``sources``; a null source is an empty text."""
    c = F.coalesce(F.col(column), F.lit(""))
    pre = preamble(c)
    return sources.select(
        "*",
        title(c).alias("title"),
        authors(c).alias("authors"),
        abstract(c).alias("abstract"),
        keywords(c).alias("keywords"),
        sections(c).alias("sections"),
        acknowledgments(c).alias("acknowledgments"),
        ccs_concepts(c).alias("ccs_concepts"),
        ccsxml(c).alias("ccsxml"),
        source_packages(pre).alias("source_packages"),
        tikz_libraries(pre).alias("tikz_libraries"),
    )


def format_guard(c: Column, source: str) -> Column:
    """Warnings about a source that doesn't look like its declared format."""
    own, other = (K.IEEE_CLASS, K.ACM_CLASS) if source == "ieee" else (K.ACM_CLASS, K.IEEE_CLASS)
    marks, target = (K.ACM_MARKERS, "acm") if source == "ieee" else (K.IEEE_MARKERS, "ieee")
    return F.array_compact(
        F.array(
            F.when(c.rlike(other), f"class of {target}").when(c.rlike(marks), f"commands of {target}"),
            F.when(~c.rlike(own), f"no class of {source}"),
        )
    )


def cite_keys(c: Column) -> Column:
    """Distinct citation keys, ascending."""
    groups = F.regexp_extract_all(c, F.lit(r"\\cite\{([^}]+)\}"), 1)
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: strip(k))))
    return F.array_sort(F.array_distinct(keys))


def unresolved_refs(c: Column, prefix: str) -> Column:
    """Distinct reference targets with the prefix that no label has, ascending."""
    targets = F.filter(F.regexp_extract_all(c, F.lit(r"\\ref\{([^}]+)\}"), 1), lambda x: x.startswith(prefix))
    return F.array_sort(F.array_except(targets, F.regexp_extract_all(c, F.lit(r"\\label\{([^}]+)\}"), 1)))


def missing_sections(section_array: Column, wanted: list[str]) -> Column:
    """Wanted titles that no section has, whatever the case."""
    present = F.transform(section_array, lambda s: F.lower(strip(s["title"])))
    return let(present, lambda p: F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: ~F.array_contains(p, F.lower(w))))


def citation_status(c: Column, known: Column) -> Column:
    """Struct of status (pass or warn) and unresolved keys of a rendered text."""
    bib = F.contains(c, F.lit(r"\bibliography{")) | F.contains(c, F.lit(r"\printbibliography")) | F.contains(c, F.lit(r"\begin{thebibliography}"))
    cites = F.contains(c, F.lit(r"\cite{"))
    return let(
        F.struct(cite_keys(c).alias("keys"), F.array_except(cite_keys(c), known).alias("open")),
        lambda s: F.struct(
            F.when(~bib | ~cites, "warn")
            .when((F.size(known) > 0) & (F.size(s["open"]) > 0) & (F.size(s["open"]) == F.size(s["keys"])), "warn")
            .otherwise("pass")
            .alias("status"),
            s["open"].alias("unresolved"),
        ),
    )
