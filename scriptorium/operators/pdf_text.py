"""Text extracted from pages: cleaning, typing, front matter, sections.

Lines stay arrays inside the row of their document, so nothing here shuffles.  A
document is one row's work; some steps look through its lines once for each line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import predicates as P
from ..functions.text import (
    cleanup,
    collapse,
    count_present,
    drop_reference_tail,
    heading,
    let,
    lines_of,
    n_words,
    normalize_spacing,
    normalize_symbols,
    remove_all,
    repair_drop_cap,
    repair_hyphenation,
    repeated,
    section_boundaries,
    split_list,
    strip,
    text,
)


def repeated_lines(c: Column, least: int = 25) -> Column:
    """Distinct trimmed lines over ``least`` characters that occur twice or more."""
    return repeated(F.transform(lines_of(c), lambda x: strip(x)), least)


def keep_lines(c: Column) -> Column:
    """Lines without repeated ones and boilerplate.

    Of repeated lines over 30 characters the first stays if it stands before the
    first line that names the abstract, keywords or introduction.
    """

    def kept(lines: Column) -> Column:
        boundary = F.coalesce(
            F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(K.FRONTMATTER_BOUNDARY), i)), lambda i: i.isNotNull()), 0),
            F.lit(2**31 - 1),
        )
        parts = F.struct(lines.alias("l"), repeated(lines, 30).alias("r"), boundary.alias("b"))
        return let(
            parts,
            lambda p: F.filter(
                p["l"],
                lambda x, i: (x == "")
                | F.when(F.array_contains(p["r"], x), (i < p["b"]) & (F.array_position(p["l"], x) == i + 1)).otherwise(
                    ~P.is_header_footer(x)
                ),
            ),
        )

    return let(F.transform(lines_of(c), lambda x: strip(x)), kept)


def clean(c: Column, mode: str = "safe") -> Column:
    """Cleaned text: line filters, then passes over the whole text in a fixed order."""
    t = F.array_join(keep_lines(c), "\n")
    t = remove_all(t, K.HEADER_FOOTER + K.INLINE_NOISE)
    t = normalize_symbols(repair_hyphenation(normalize_spacing(drop_reference_tail(section_boundaries(t)))))
    if mode == "aggressive":
        t = normalize_spacing(remove_all(t, K.AGGRESSIVE))
    return t


def document_type(c: Column) -> Column:
    """Struct of kind and scores by cues in the first 20000 characters."""
    kinds = (("thesis", K.THESIS_CUES), ("paper", K.PAPER_CUES), ("ieee", K.IEEE_CUES), ("acm", K.ACM_CUES))
    return let(
        let(F.lower(F.substring(text(c), 1, 20000)), lambda low: F.struct(*[count_present(low, cues).alias(n) for n, cues in kinds])),
        lambda s: F.struct(
            F.when(s["thesis"] >= 3, "thesis_dissertation")
            .when(s["ieee"] >= 1, "ieee_paper")
            .when(s["acm"] >= 1, "acm_paper")
            .otherwise("generic_academic_pdf")
            .alias("kind"),
            *[s[n].alias(n) for n in ("thesis", "paper", "ieee", "acm")],
        ),
    )


def guess_format(c: Column) -> Column:
    head = F.substring(text(c), 1, 5000)
    return F.when(F.contains(head, F.lit("IEEE")), "ieee").when(F.contains(head, F.lit("ACM")), "acm").otherwise("unknown")


_INTRO = r"(?:^|\n)(?:I\.\s*INTRODUCTION|\d+(?:\.\d+)?\.?\s*INTRODUCTION|INTRODUCTION)\b"


def _first_of(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, "(?is)" + p, 1), F.lit("")) for p in patterns], F.lit(""))


def abstract(c: Column) -> Column:
    stop = f"(?:Index Terms|Keywords|{_INTRO})"
    return cleanup(_first_of(c, [rf"Abstract[\s—-]+(.*?){stop}", rf"Abstract\s*(.*?){stop}", rf"Abstract\s*(.*?)(?:{_INTRO})"]))


def keywords(c: Column) -> Column:
    return split_list(cleanup(_first_of(c, [rf"Index Terms[\s—-]+(.*?)(?:{_INTRO})", rf"Keywords[\s—-]+(.*?)(?:{_INTRO})"])), "[,;]")


def emails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(f"({K.EMAIL})"), 1))


def affiliations(items: Column) -> Column:
    """Distinct entries of 5 to 120 characters that name an institution."""
    tidy = F.transform(items, lambda x: collapse(x))
    named = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(h)) for h in K.AFFILIATION_HINTS])
    return F.array_distinct(F.filter(tidy, lambda x: F.length(x).between(5, 120) & named(x)))


def paired(items: Column, authors: Column) -> Column:
    """As many items as there are authors, one at least."""
    return F.slice(items, 1, F.greatest(F.lit(1), F.size(authors)))


def title_of(c: Column) -> Column:
    """First one or two title lines among the first twenty, behind banners."""
    head = lambda x: n_words(x).between(3, 25) & (F.length(x) <= 200)
    stop = lambda x: x.rlike(K.FRONTMATTER_END) | F.contains(x, F.lit("@")) | x.rlike(r"(?i)\bdoi\b")

    first_at = lambda a, test: F.get(F.filter(F.transform(a, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()), 0)
    judged = lambda x: let(
        P.is_title_noise(x), lambda noise: F.struct(x.alias("x"), noise.alias("noise"), (~noise & stop(x)).alias("stop"), (~noise & head(x)).alias("head"))
    )
    goes_on = lambda n: ~n["noise"] & n["head"] & ~n["x"].rlike(K.FRONTMATTER_END) & ~F.contains(n["x"], F.lit("@")) & ~P.is_authors(n["x"])

    def pick(lines: Column) -> Column:
        return let(
            F.struct(lines.alias("l"), first_at(lines, lambda x, i: x["head"] | x["stop"]).alias("at")),
            lambda s: F.when(s["at"].isNull() | F.get(s["l"], s["at"])["stop"], F.lit("")).otherwise(
                F.concat_ws(" ", F.get(s["l"], s["at"])["x"], let(F.get(s["l"], s["at"] + 1), lambda n: F.when(goes_on(n), n["x"])))
            ),
        )

    return let(F.transform(F.slice(F.filter(F.transform(lines_of(c), lambda x: strip(x)), lambda x: x != ""), 1, 20), judged), pick)


def author_profiles(lines: Column) -> Column:
    """Per-author blocks of front-matter lines: a name line opens one; department,
    institution, place and email below belong to it.  Kept if there are several, or
    if the only one has an email or an institution."""
    empty = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("name", "department", "institution", "place", "email")])

    def with_(p: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, p[n]).alias(n) for n in ("name", "department", "institution", "place", "email")])

    def judged(raw: Column) -> Column:
        return let(
            collapse(raw),
            lambda s: F.struct(
                s.alias("s"),
                F.contains(s, F.lit("@")).alias("mail"),
                P.is_authors(s).alias("name"),
                P.is_affiliation(s).alias("aff"),
                P.is_institution(s).alias("inst"),
                P.is_location(s).alias("place"),
            ),
        )

    def step(acc: Column, line: Column) -> Column:
        s, p = line["s"], acc["cur"]
        opened = p["name"].isNotNull()
        full = p["email"].isNotNull() | p["institution"].isNotNull() | p["department"].isNotNull() | p["place"].isNotNull()
        mail = F.nullif(F.regexp_extract(s, K.EMAIL, 0), F.lit(""))
        name_line = ~line["mail"] & line["name"]
        cur = (
            F.when(s == "", p)
            .when(line["mail"], F.when(opened, with_(p, email=F.coalesce(mail, p["email"]))).otherwise(p))
            .when(name_line, with_(empty, name=s))
            .when(~opened, p)
            .when(line["aff"] & line["inst"], with_(p, institution=F.coalesce(p["institution"], s)))
            .when(line["aff"], with_(p, department=F.coalesce(p["department"], s)))
            .when(line["place"], with_(p, place=s))
            .otherwise(p)
        )
        done = F.when(name_line & opened & full, F.concat(acc["done"], F.array(p))).otherwise(acc["done"])
        return F.struct(done.alias("done"), cur.alias("cur"))

    def finish(acc: Column) -> Column:
        p = acc["cur"]
        full = p["name"].isNotNull() & (p["email"].isNotNull() | p["institution"].isNotNull() | p["department"].isNotNull() | p["place"].isNotNull())
        every = F.when(full, F.concat(acc["done"], F.array(p))).otherwise(acc["done"])
        only = F.get(every, 0)
        keep = (F.size(every) > 1) | F.coalesce(only["email"].isNotNull() | only["institution"].isNotNull(), F.lit(False))
        return F.when(keep, every).otherwise(F.slice(every, 1, 0))

    start = F.struct(F.filter(F.array(empty), lambda x: x["name"].isNotNull()).alias("done"), empty.alias("cur"))
    return F.aggregate(F.transform(lines, judged), start, step, finish)


def headings(lines: Column) -> Column:
    """Array of (at, title): numbered headings, and plain ones that prose, a reference
    or a subsection follows."""

    def plain(x: Column, i: Column, all_: Column) -> Column:
        n = collapse(x)
        nxt = F.coalesce(F.get(F.filter(F.slice(all_, i + 2, F.size(all_)), lambda y: y != ""), 0), F.lit(""))
        shape = (
            ~F.lower(n).isin(*K.NO_HEADINGS)
            & n.rlike(K.PLAIN_HEADING)
            & ~(n.rlike(r"^\S{1,3}$") & (n == F.upper(n)) & n.rlike("[A-Z]"))
        )
        return F.when(shape, let(nxt, lambda y: (y != "") & (P.is_body_line(y) | P.is_reference_lead(y) | P.is_subsection(y)))).otherwise(False)

    return let(
        lines,
        lambda ls: F.filter(
            F.transform(
                ls,
                lambda x, i: F.when(
                    (x != "") & (x.rlike(K.ROMAN_HEADING) | x.rlike(K.ARABIC_HEADING) | plain(x, i, ls)),
                    F.struct(i.alias("at"), x.alias("title")),
                ),
            ),
            lambda h: h.isNotNull(),
        ),
    )


def paragraphs(lines: Column) -> Column:
    """Lines joined to paragraphs: blank and skipped lines, list marks and captions
    behind a sentence's end separate them."""

    def starts(prev: Column, x: Column) -> Column:
        return (
            x.rlike(r"^(?:\d+\)|\(\d+\)|[A-Z]\.)\s+|^\d+\.\d+\s+")
            | (prev.rlike(r"^\d+\.\d+$") & x.rlike(r"^\p{Lu}"))
            | (prev.rlike(r"[.!?]$") & x.rlike(r"^(?:Fig\.|Figure|Table|TABLE)\s+\d+"))
        )

    def step(acc: Column, raw: Column) -> Column:
        x = strip(raw)
        skip = P.is_skipped_in_section(x)
        glue = F.when(acc["t"] == "", "").when((acc["prev"] == "") | starts(acc["prev"], x), "\n\n").otherwise(" ")
        return F.struct(
            F.when(skip, acc["t"]).otherwise(F.concat(acc["t"], glue, collapse(x))).alias("t"),
            F.when(skip, F.lit("")).otherwise(x).alias("prev"),
        )

    return F.aggregate(lines, F.struct(F.lit("").alias("t"), F.lit("").alias("prev")), step, lambda a: a["t"])


def fallback_section(c: Column) -> Column:
    """One section "Body": what follows the first three blank-line chunks, if there are more."""
    return let(
        split_list(text(c), r"\n\n+"),
        lambda p: F.when(
            F.size(p) > 0,
            F.array(F.struct(F.lit("Body").alias("title"), cleanup(F.array_join(F.when(F.size(p) > 3, F.slice(p, 4, F.size(p))).otherwise(p), " ")).alias("content"))),
        ).otherwise(F.array().cast("array<struct<title:string,content:string>>")),
    )


def sections(c: Column) -> Column:
    """Array of (title, content) by heading lines; short bodies are dropped."""

    def cut(ls: Column) -> Column:
        return let(
            F.struct(ls.alias("l"), headings(ls).alias("h")),
            lambda s: F.transform(
                s["h"],
                lambda h, k: F.struct(
                    heading(h["title"]).alias("title"),
                    repair_drop_cap(
                        paragraphs(
                            F.slice(s["l"], h["at"] + 2, F.coalesce(F.get(s["h"], k + 1)["at"], F.size(s["l"])) - h["at"] - 1)
                        )
                    ).alias("content"),
                ),
            ),
        )

    found = F.filter(
        let(F.transform(lines_of(c), lambda x: strip(x)), cut),
        lambda s: F.length(s["content"]) >= F.when(F.lower(s["title"]).isin(*K.REFERENCE_TITLES), 8).otherwise(40),
    )
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(fallback_section(c)))


def captions(content: Column, kind: str) -> Column:
    """Array of (label, caption) of figure or table captions in prose."""
    trim = lambda x: F.regexp_replace(x, r"^[ .:\-]+|[ .:\-]+$", "")
    if kind == "figure":
        pattern, label = r"(?i)((?:Fig\.|Figure)\s*\d+\.?\s*[^\n]{0,100})", "fig:"
        number, rest = r"(?i)(?:Fig\.|Figure)\s*(\d+)", r"(?i)(?:Fig\.|Figure)\s*\d+\.?\s*([^\n]{0,100})"
        bad = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(p)) for p in K.NO_CAPTION])
        good = lambda x: (F.length(x) >= 8) & ~bad(x) & (n_words(x) >= 4) & x.rlike(r"^\p{Lu}")
    else:
        pattern, label = r"(?i)(TABLE\s+[IVXLC0-9]+\s+[^\n]{0,120})", "tab:"
        number, rest = r"(?i)TABLE\s+([IVXLC0-9]+)", r"(?i)TABLE\s+[IVXLC0-9]+\s+([^\n]{0,120})"
        good = lambda x: (F.length(x) >= 12) & (n_words(x) >= 3)
    made = F.transform(
        F.regexp_extract_all(content, F.lit(pattern), 1),
        lambda m: F.struct(
            F.concat(F.lit(label), F.lower(F.regexp_extract(m, number, 1))).alias("label"), trim(F.regexp_extract(m, rest, 1)).alias("caption")
        ),
    )
    return F.filter(made, lambda m: good(m["caption"]))


def clean_content(c: Column) -> Column:
    """Section text without captions and scan marks, white space collapsed."""
    c = F.regexp_replace(c, r"(?i)(?:Fig\.|Figure)\s*\d+\.?\s*[^\n]{0,120}", " ")
    c = F.regexp_replace(c, r"(?i)TABLE\s+[IVXLC0-9]+\s*[^\n]{0,160}", " ")
    c = F.regexp_replace(c, r"\b(?:Scan|Registration)\b\s+\d+(?:\s+\d+)*", " ")
    return collapse(c)


def caption_candidates(c: Column, figures: int = 4, tables: int = 3) -> Column:
    """The first figure and table captions of a text."""
    return F.concat(F.slice(captions(c, "figure"), 1, figures), F.slice(captions(c, "table"), 1, tables))


def bracket_citations(content: Column, known: Column) -> Column:
    """``[n]`` to a citation of ``refn`` where that key is known."""
    parts = F.regexp_extract_all(content, F.lit(r"(?s)(\[\d+\]|.[^\[]*)"), 1)
    key = lambda p: F.concat(F.lit("ref"), F.regexp_extract(p, r"^\[(\d+)\]$", 1))
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p.rlike(r"^\[\d+\]$") & F.array_contains(known, key(p)), F.concat(F.lit("\\cite{"), key(p), F.lit("}"))).otherwise(p),
        ),
        "",
    )


def reference_entries(c: Column) -> Column:
    """Array of (key, raw): ``[n]`` entries, else ``n.`` or ``n)`` ones, of ten characters or more."""
    bracket = F.regexp_extract_all(c, F.lit(r"(?s)(\[\d+\]\s*.*?)(?=\s*\[\d+\]|\z)"), 1)
    numbered = F.regexp_extract_all(c, F.lit(r"(?s)(?:^|\s)(\d+[.)]\s*.*?)(?=\s+\d+[.)]|\z)"), 1)
    made = F.transform(
        F.when(F.size(bracket) > 0, bracket).otherwise(numbered),
        lambda m: F.struct(
            F.concat(F.lit("ref"), F.regexp_extract(m, r"(\d+)", 1)).alias("key"),
            collapse(F.regexp_replace(m, r"^(?:\[\d+\]|\d+[.)])", "")).alias("raw"),
        ),
    )
    return F.filter(made, lambda r: F.length(r["raw"]) >= 10)


def last_by_key(references: Column) -> Column:
    """One entry for each key: the last value, at the first position."""
    keys = F.array_distinct(F.transform(references, lambda r: r["key"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(references, lambda r: r["key"] == k), -1))


def citation_fields(raw: Column) -> Column:
    """Year, volume, number, pages, quoted title, venue kind of a raw citation."""
    g = lambda p: F.regexp_extract(raw, p, 1)
    return F.struct(
        F.when(raw.rlike(r"(?i)proceedings|conference|symposium|workshop"), "inproceedings").when(raw.rlike(r"(?i)journal|transactions|vol\."), "article").otherwise("misc").alias("kind"),
        g(r"\b((?:19|20)\d{2})\b").alias("year"),
        g(r"(?i)\bvol\.\s*(\d+)").alias("volume"),
        g(r"(?i)\bno\.\s*(\d+)").alias("number"),
        F.replace(g(r"(?i)\bpp?\.\s*(\d+\s*[-–]+\s*\d+)"), F.lit("–"), F.lit("-")).alias("pages"),
        g("[\"“]([^\"”]+)[\"”]").alias("quoted"),
    )


def parse(sources: DataFrame, column: str = "pdf") -> DataFrame:
    """Add the record's fields to ``sources`` by the text path alone."""
    c = F.col("cleaned")
    known = F.transform("references", lambda r: r["key"])
    return (
        sources.withColumn("cleaned", clean(F.col(column)))
        .select(
            "*",
            title_of(c).alias("title"),
            abstract(c).alias("abstract"),
            keywords(c).alias("keywords"),
            emails(c).alias("emails"),
            last_by_key(reference_entries(F.regexp_extract(c, r"(?is)\bREFERENCES\b(.*)$", 1))).alias("references"),
            document_type(F.col(column))["kind"].alias("kind"),
        )
        .withColumn(
            "sections",
            F.transform(sections(c), lambda s: F.struct(s["title"].alias("title"), bracket_citations(clean_content(s["content"]), known).alias("content"))),
        )
    )
