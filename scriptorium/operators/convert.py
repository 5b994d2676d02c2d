"""From parsed records to a target venue: normalise, render, validate, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import collapse, escape_latex, strip
from . import latex

TARGETS = {"ieee": "acm", "acm": "ieee"}


def route(source: Column, target: Column) -> Column:
    """``ieee->acm`` or ``acm->ieee``; any other pair raises when it is evaluated."""
    pair = F.concat_ws("->", F.lower(source), F.lower(target))
    return F.when(pair.isin("ieee->acm", "acm->ieee"), pair).otherwise(
        F.raise_error(F.concat(F.lit("unsupported direction: "), pair)).cast("string")
    )


def normalize(records: DataFrame) -> DataFrame:
    """Collapse white space in title, authors, keywords and section titles."""
    tidy = lambda a: F.filter(F.transform(a, lambda x: collapse(x)), lambda x: x != "")
    return records.withColumns(
        {
            "title": collapse(F.col("title")),
            "authors": tidy(F.col("authors")),
            "keywords": tidy(F.transform("keywords", lambda k: F.replace(k, F.lit(";"), F.lit(",")))),
            "sections": F.transform(
                "sections",
                lambda s: F.struct(s["ord"].alias("ord"), collapse(s["title"]).alias("title"), strip(s["content"]).alias("content")),
            ),
        }
    )


def _messages(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))


def normalization_warnings(target: str) -> Column:
    empty = lambda n: F.size(n) == 0
    concepts = F.size("ccs_concepts") > 0
    venue = (
        (concepts & (F.col("ccsxml") == ""), "CCS concepts without CCSXML")
        if target == "acm"
        else (concepts, "CCS concepts omitted")
    )
    return _messages(venue, (empty("authors"), "no authors"), (F.col("abstract") == "", "no abstract"), (empty("references"), "no references"))


def unresolved_items(target: str) -> Column:
    """What a reviewer has to complete by hand, by the rules of the target venue."""
    empty = lambda n: F.size(n) == 0
    body = F.array_join(F.transform("sections", lambda s: s["content"]), " ")
    titled = lambda *names: F.exists("sections", lambda s: F.lower(s["title"]).isin(*names))
    head = [(strip(F.col("title")) == "", "title"), (strip(F.col("abstract")) == "", "abstract"), (empty("authors"), "authors")]
    concepts = F.size("ccs_concepts") > 0
    if target == "acm":
        rules = [
            (concepts & (F.col("ccsxml") == ""), "ccsxml"),
            (empty("emails") & empty("affiliations"), "affiliations"),
            (F.lit(True), "conference"),  # no reader fills the venue
            (empty("keywords"), "keywords"),
            (body.rlike(r"(?i)\\IEEEauthorblock[NA]"), "ieee author blocks"),
            (titled("biography", "biographies", "about the authors"), "biographies"),
            (body.rlike(r"(?i)\\IEEEpeerreviewmaketitle"), "peer review title"),
            (F.size("figures") > 10, "many figures"),
            (F.size("tables") > 5, "many tables"),
        ]
    else:
        rules = [
            (concepts, "ccs concepts stripped"),
            (F.lit(True), "conference"),
            (titled("ccs concepts", "keywords"), "acm sections"),
            (F.size("figures") > 15, "many figures"),
            (F.size("tables") > 5, "many tables"),
        ]
    return _messages(*head, *rules, (empty("references"), "references"))


def escape_all(a: Column) -> Column:
    return F.transform(a, lambda x: escape_latex(x))


def render_authors(target: str) -> Column:
    """IEEE: names, then affiliations, then emails, joined by ``\\and``.  ACM: a block
    to an author; entries beyond the authors follow the last one."""
    names, aff, mail = (escape_all(F.col(c)) for c in ("authors", "affiliations", "emails"))
    if target == "ieee":
        join = lambda a: F.when(F.size(a) > 0, F.array_join(a, r" \and "))
        made = F.concat_ws(r" \\ ", join(names), join(aff), join(mail))
    else:
        wrap = lambda open_, c, close: F.concat(F.lit(open_), c, F.lit(close))
        institution = lambda c: wrap(r"\affiliation{\institution{", c, "}}")
        email = lambda c: wrap(r"\email{", c, "}")
        rest = lambda a, one: F.transform(F.slice(a, F.size("authors") + 1, F.size(a)), one)
        blocks = F.transform(
            names,
            lambda n, i: F.concat_ws("\n", wrap(r"\author{", n, "}"), institution(F.get(aff, i)), email(F.get(mail, i))),
        )
        made = F.array_join(F.concat(blocks, rest(aff, institution), rest(mail, email)), "\n")
    return F.when(F.size("authors") == 0, F.lit("Anonymous")).otherwise(made)


def render_keywords(target: str) -> Column:
    joined = F.array_join(escape_all(F.col("keywords")), ", ")
    block = (
        F.concat(F.lit("\\begin{IEEEkeywords}\n"), joined, F.lit("\n\\end{IEEEkeywords}"))
        if target == "ieee"
        else F.concat(F.lit("\\keywords{"), joined, F.lit("}"))
    )
    return F.when(F.size("keywords") == 0, F.lit("")).otherwise(block)


def render_frontmatter(target: str) -> Column:
    if target == "ieee":
        return F.lit("")
    xml = F.when(F.col("ccsxml") != "", F.concat(F.lit("\\begin{CCSXML}\n"), F.col("ccsxml"), F.lit("\n\\end{CCSXML}")))
    concepts = F.transform("ccs_concepts", lambda c: F.concat(F.lit("\\ccsdesc{"), c, F.lit("}")))
    return F.concat_ws("\n", F.lit("\n".join(K.ACM_FRONTMATTER)), xml, concepts)


def section_title(t: Column) -> Column:
    low = F.lower(strip(t))
    return F.when(low == "background", "Background").when(low.isin("conclusion", "conclusions"), "Conclusion").otherwise(t)


def render_body(is_latex: bool = True) -> Column:
    """Sections in order; the bibliography's own section is left to its block."""
    kept = F.filter("sections", lambda s: ~F.lower(strip(s["title"])).isin(*K.REFERENCE_TITLES))
    made = F.transform(
        kept,
        lambda s: F.concat(
            F.lit("\\section{"),
            section_title(s["title"]),
            F.lit("}\n"),
            s["content"] if is_latex else escape_latex(s["content"]),
            F.lit("\n\\FloatBarrier\n" if is_latex else "\n"),
        ),
    )
    return F.array_join(made, "\n")


def render_acknowledgments(target: str) -> Column:
    a = strip(F.col("acknowledgments"))
    open_, close = ("\n\\begin{acks}\n", "\n\\end{acks}\n") if target == "acm" else ("\n\\section*{Acknowledgments}\n", "\n")
    return F.when(a == "", F.lit("")).otherwise(F.concat(F.lit(open_), a, F.lit(close)))


def render_figures(figures: Column) -> Column:
    asset = lambda f: F.when(f["path"] != "", F.concat(F.lit("\\includegraphics[width=\\linewidth]{"), f["path"], F.lit("}"))).otherwise(
        F.lit("% Figure asset unavailable from PDF ingest")
    )
    return F.array_join(
        F.transform(
            figures,
            lambda f: F.concat_ws(
                "\n",
                F.concat(F.lit("\\begin{figure}["), f["placement"], F.lit("]")),
                F.lit("\\centering"),
                asset(f),
                F.concat(F.lit("\\caption{"), f["caption"], F.lit("}")),
                F.concat(F.lit("\\label{"), f["label"], F.lit("}")),
                F.lit("\\end{figure}"),
            ),
        ),
        "\n\n",
    )


def render_main(target: str) -> Column:
    """The whole main file of a LaTeX-sourced record for the target venue."""
    begin = [K.CLASS_LINE[target], *K.PACKAGES, r"\begin{document}"]
    head = F.concat(F.lit("\\title{"), F.col("title"), F.lit("}"))
    who = render_authors(target)
    abstract = F.concat(F.lit("\\begin{abstract}\n"), F.col("abstract"), F.lit("\n\\end{abstract}"))
    bib = F.lit(f"\\bibliographystyle{{{K.BIB_STYLE[target]}}}\n\\bibliography{{references}}")
    body = F.concat(render_body(), render_acknowledgments(target))
    front = [render_keywords(target), render_frontmatter(target)]
    if target == "ieee":
        middle = [F.concat(F.lit("\\author{"), who, F.lit("}")), F.lit(r"\maketitle"), abstract, *front]
    else:
        middle = [who, abstract, *front, *[F.lit(x) for x in K.ACM_PAGE_STYLE]]
    return F.concat_ws("\n", *[F.lit(x) for x in begin], head, *middle, body, bib, F.lit("\\end{document}\n"))


def render_bib(references: Column) -> Column:
    """BibTeX text: complete entries as they are, other raw strings as notes; the
    first of equal keys counts."""
    keys = F.transform(references, lambda r: r["key"])
    firsts = F.filter(references, lambda r, i: F.array_position(keys, r["key"]) == i + 1)
    entries = F.transform(
        firsts,
        lambda r: F.when(strip(r["raw"]).rlike(r"(?s)^@.*\{.*\}$"), strip(r["raw"])).otherwise(
            F.concat(F.lit("@misc{"), r["key"], F.lit(",\n  note={"), F.translate(strip(r["raw"]), "{}", "()"), F.lit("},\n}"))
        ),
    )
    return F.when(F.size(references) == 0, F.lit("% No references extracted\n")).otherwise(F.concat(F.array_join(entries, "\n\n"), F.lit("\n")))


def render_thebibliography(references: Column) -> Column:
    width = F.greatest(F.lit(2), F.length(F.size(references).cast("string")))
    items = F.transform(references, lambda r: F.concat(F.lit("\\bibitem{"), r["key"], F.lit("} "), escape_latex(F.regexp_replace(strip(r["raw"]), r"\s+", " "))))
    full = F.concat(F.lit("\\begin{thebibliography}{"), F.repeat(F.lit("9"), width), F.lit("}\n"), F.array_join(items, "\n"), F.lit("\n\\end{thebibliography}\n"))
    return F.when(F.size(references) == 0, F.lit("\\begin{thebibliography}{00}\n\\end{thebibliography}\n")).otherwise(full)


def validate(main: Column, sections: Column, known: Column, target: str) -> Column:
    """Struct of template and citation compliance, warnings and errors."""
    count = lambda s: F.regexp_count(main, F.lit(s))
    missing = latex.missing_sections(sections, K.REQUIRED_SECTIONS)
    gaps = F.array_except(latex.missing_sections(sections, K.EXPECTED_SECTIONS), missing)
    has_body = F.exists(sections, lambda s: F.length(strip(s["content"])) > 0)
    ends, begins = F.contains(main, F.lit(r"\end{document}")), F.contains(main, F.lit(r"\begin{document}"))
    lacks = F.size(missing) > 0
    cites = latex.citation_status(main, known)
    errors = _messages(
        (count(r"\\end\{document\}") > 1, "several ends"),
        (count(r"\\begin\{document\}") > 1, "several beginnings"),
        (count(r"\\title\{") > 1, "several titles"),
        (lacks & ~has_body, "no required section and no body"),
        (~ends, "no end"),
        (~begins, "no beginning"),
    )
    cls = {"ieee": "IEEEtran", "acm": "acmart"}[target]
    warnings = _messages(
        (lacks & has_body, "required sections missing"),
        (F.size(gaps) > 0, "expected sections missing"),
        (cites["status"] == "warn", "citations"),
        *[(main.rlike(p), f"pattern {i}") for i, p in enumerate(K.FORBIDDEN[target])],
        (F.contains(main, F.lit(r"\documentclass")) & ~F.contains(main, F.lit(cls)), "class"),
        (F.size(latex.unresolved_refs(main, "fig:")) > 0, "figure refs"),
        (F.size(latex.unresolved_refs(main, "tab:")) > 0, "table refs"),
        (main.rlike(r"(?m)\\[A-Za-z]+\s*$") & ~ends, "broken command"),
    )
    template = F.when(~ends | ~begins | (lacks & ~has_body), "fail").when(lacks, "warn").otherwise("pass")
    return F.struct(template.alias("template"), cites["status"].alias("citation"), warnings.alias("warnings"), errors.alias("errors"))


def harmonize(main: Column) -> Column:
    """Unix line ends; one pass that turns three line ends into two."""
    return F.replace(F.regexp_replace(main, r"\r\n", "\n"), F.lit("\n\n\n"), F.lit("\n\n"))


def repair(main: Column, attempt: int) -> Column:
    """Text repairs before another compiler run: one end, the last of repeated
    bibliography commands, a graphics package at first, a bibliography later."""
    end = r"\end{document}"
    text = F.when(F.regexp_count(main, F.lit(r"\\end\{document\}")) > 1, F.concat(F.substring_index(main, end, 1), F.lit(end + "\n"))).otherwise(main)
    for mark in (r"\\bibliographystyle", r"\\bibliography\{references\}", r"\\begin\{thebibliography\}"):
        text = F.regexp_replace(text, rf"(?s){mark}[^\n]*\n(?=.*{mark})", "")
    if attempt == 0:
        lacks = ~F.contains(text, F.lit(r"\usepackage{graphicx}"))
        return F.when(lacks, F.regexp_replace(text, r"(?s)^(.*?)\\begin\{document\}", "$1\\\\usepackage{graphicx}\n\\\\begin{document}")).otherwise(text)
    bare = ~F.contains(text, F.lit(r"\bibliography{references}")) & ~F.contains(text, F.lit(r"\begin{thebibliography}"))
    text = F.when(bare, F.regexp_replace(text, r"(?s)^(.*?)\\end\{document\}", "$1\\\\bibliography{references}\n\\\\end{document}")).otherwise(text)
    style = F.when(F.contains(text, F.lit("{acmart}")), K.BIB_STYLE["acm"]).otherwise(K.BIB_STYLE["ieee"])
    bare = ~F.contains(text, F.lit(r"\bibliographystyle")) & F.contains(text, F.lit(r"\bibliography{references}"))
    put = F.concat(F.lit(r"\bibliographystyle{"), style, F.lit("}\n\\bibliography{references}"))
    at = F.instr(text, r"\bibliography{references}")
    return F.when(bare, F.overlay(text, put, at, F.lit(len(r"\bibliography{references}")))).otherwise(text)


def final_status(template: Column, compiled: Column, has_compiler: Column) -> Column:
    """``success`` where the template passes or warns and nothing failed to compile."""
    return F.when(template.isin("pass", "warn") & ((compiled == "success") | ~has_compiler), "success").otherwise("failed")


def compiled(has_pdf: Column, log: Column, markers: list[str]) -> Column:
    return has_pdf & reduce(lambda a, b: a | b, [F.contains(log, F.lit(m)) for m in markers])


def summary() -> list[Column]:
    """Counts and flags of a record."""
    n = lambda c: F.size(c).cast("long")
    return [
        n("sections").alias("n_sections"),
        n("figures").alias("n_figures"),
        n("tables").alias("n_tables"),
        n("references").alias("n_references"),
        n("authors").alias("n_authors"),
        (F.length(strip(F.col("abstract"))) > 0).alias("abstract_present"),
    ]


def confidence() -> Column:
    """Share of the fields that came out well, to two digits."""
    words = F.size(F.split(collapse(F.col("title")), " "))
    parts = [
        (words > 3, 0.2),
        (F.length("abstract") > 200, 0.2),
        (F.size("sections") >= 4, 0.2),
        (F.size("keywords") > 0, 0.1),
        (F.size("authors") > 0, 0.1),
        (F.size("references") > 0, 0.1),
        ((F.size("emails") > 0) | (F.size("affiliations") > 0), 0.1),
    ]
    return F.round(reduce(lambda a, b: a + b, [F.when(c, F.lit(v)).otherwise(F.lit(0.0)) for c, v in parts]), 2)
