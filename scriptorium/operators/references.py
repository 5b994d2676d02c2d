"""Bibliographies inside sections, and the fields of raw citations (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .. import schema as S
from ..functions.text import collapse, let, n_words, strip, strip_reference_noise, text
from .pdf_text import last_by_key, reference_entries

YEAR = r"\b(?:19|20)\d{2}\b"
_VENUE = r"(?i)\b(?:conference|proceedings|transactions|journal|pages?)\b"


def continues_references(section: Column) -> Column:
    """Whether a section behind the references goes on with them: six words or more that
    hold an entry's number, or a year and a venue."""
    whole = strip(F.concat_ws(" ", section["title"], section["content"]))
    return (n_words(whole) >= 6) & (whole.rlike(r"\[\d+\]") | (whole.rlike(YEAR) & whole.rlike(_VENUE)))


def split_bibliography(content: Column, eager: Column) -> Column:
    """(body, tail) where a bibliography ends the content, else (content, null).

    The tail behind the first mark must be 20 characters and parse to several
    entries, or to one of four words and a year; the body must have 25 words unless
    ``eager``.
    """
    pattern = r"(?s)^(.*?)" + K.REFERENCE_MARK + r"(.*)$"

    def of(parts: Column) -> Column:
        entries = F.when(F.length(parts["tail"]) >= 20, reference_entries(parts["tail"]))
        only = F.get(entries, 0)["raw"]
        listed = (F.size(entries) > 1) | ((F.size(entries) == 1) & only.rlike(YEAR) & (n_words(only) >= 4))
        return F.when(listed & (eager | (n_words(parts["body"]) >= 25)), parts).otherwise(whole)

    whole = F.struct(content.alias("body"), F.lit(None).cast("string").alias("tail"))
    halves = F.struct(strip(F.regexp_extract(content, pattern, 1)).alias("body"), strip_reference_noise(F.regexp_extract(content, pattern, 2)).alias("tail"))
    return F.when(content.rlike(K.REFERENCE_MARK), let(halves, of)).otherwise(whole)


def _flagged(sections: Column) -> Column:
    """Pieces (kind, title, content) of the sections in order: ``body``, ``list`` (a
    bibliography) or ``more`` (its continuation)."""
    piece = lambda kind, title, content: F.struct(F.lit(kind).alias("kind"), title.alias("title"), content.alias("content"))
    name = lambda s: F.lower(strip(s["title"]))
    references = F.lit("References")
    first = F.array_position(F.transform(sections, lambda s: name(s).isin(*K.REFERENCE_TITLES)), True)

    def pieces(s: Column, i: Column) -> Column:
        eager = name(s).isin("body", "conclusion") | (i + 1 == F.size(sections))
        more = (first > 0) & (i + 1 > first) & continues_references(s)
        split = let(
            split_bibliography(s["content"], eager),
            lambda h: F.when(h["tail"].isNull(), F.array(piece("body", s["title"], s["content"])))
            .when(h["body"] == "", F.array(piece("list", references, h["tail"])))
            .otherwise(F.array(piece("body", s["title"], h["body"]), piece("list", references, h["tail"]))),
        )
        return (
            F.when(name(s).isin(*K.REFERENCE_TITLES), F.array(piece("list", references, strip_reference_noise(s["content"]))))
            .when(more, F.array(piece("more", references, strip_reference_noise(F.concat_ws(" ", s["title"], s["content"])))))
            .otherwise(split)
        )

    return F.flatten(F.transform(sections, pieces))


def separate_references(sections: Column) -> Column:
    """(sections, references): bibliographies out of sections, their entries parsed.

    Reference sections are parsed; later sections that continue them are merged into
    the one before; a bibliography that ends a body is split off.  The last of equal
    keys counts, at the first position.  Null sections are none.
    """
    plain = F.transform(
        F.coalesce(sections, F.array().cast(S.SECTIONS)),
        lambda s: F.struct(text(s["title"]).alias("title"), text(s["content"]).alias("content")),
    )

    def merge(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["title"].alias("title"), strip(F.concat_ws(" ", last["content"], p["content"])).alias("content"))
        own = F.struct(p["title"].alias("title"), p["content"].alias("content"))
        runs_on = (p["kind"] == "more") & F.coalesce(last["title"] == "References", F.lit(False))
        return F.when(runs_on, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(own)))

    def of(pieces: Column) -> Column:
        entries = F.flatten(F.transform(F.filter(pieces, lambda p: p["kind"] != "body"), lambda p: reference_entries(p["content"])))
        return F.struct(
            F.aggregate(pieces, F.array().cast(S.SECTIONS), merge).alias("sections"),
            let(entries, last_by_key).alias("references"),
        )

    return let(let(plain, _flagged), of)


def split_citation(raw: Column) -> Column:
    """(kind, author, title, journal, booktitle, note) of a raw citation.

    The authors are a first sentence that reads like names, else all before the first
    quote or venue; the title is what is quoted, else the next sentence; the venue
    behind it names the kind, and without one the whole citation is the note.
    """
    tidy = collapse(F.translate(F.replace(F.replace(text(raw), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), "–—“”’", "--\"\"'"))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(tidy, r"\.+$", ""), r"\b\d{1,4}\s*$", ""), r"[\s.,]+$", "")
    sentence_end = r"(?<=[a-z0-9)])\.\s+"

    def of(t: Column) -> Column:
        first = F.get(F.split(t, sentence_end, 2), 0)
        venue = first.rlike(r"Journal|Conference|Proceedings|Workshop|Transactions")
        names = first.rlike(K.AUTHOR_BLOCK) & ~venue & ~F.contains(first, F.lit('"')) & (F.length(first) <= 180) & (F.length(first) < F.length(t))
        cuts = F.filter(F.array(*[F.instr(t, F.lit(m)) for m in K.CITATION_CUTS]), lambda k: k > 1)
        cut = F.when(names, F.length(first) + 1).otherwise(F.coalesce(F.array_min(cuts), F.length(t) + 1))
        return F.struct(F.substr(t, F.lit(1), cut - 1).alias("author"), F.regexp_replace(F.substr(t, cut), r"^[\s,:.]+", "").alias("rest"), t.alias("whole"))

    def fields(c: Column) -> Column:
        quoted = F.regexp_extract(c["whole"], r'"([^"]+)"', 1)
        sentence = F.get(F.split(c["rest"], sentence_end + r"| in Proc| Proc\.|, Proceedings", 2), 0)
        title = F.regexp_replace(strip(F.when(quoted != "", quoted).otherwise(sentence)), r"[,.]+$", "")
        booktitle = collapse(F.regexp_extract(c["rest"], r"\b(?:in\s+)?((?:Proc\b|Proceedings\b)[^,]*|[A-Z][^,\".]*\b(?:Conference|Conf\.|Symposium|Workshop|Congress)[^,]*)", 1))
        journal = collapse(F.regexp_extract(c["rest"], r"([A-Z][A-Za-z& ]*\b(?:Journal|Transactions|Letters|Magazine|Review)\b[^,]*|Journal[^,]*)", 1))
        kind = F.when(booktitle != "", "inproceedings").when(journal != "", "article").otherwise("misc")
        return F.struct(
            kind.alias("kind"),
            F.substr(F.regexp_replace(strip(c["author"]), r"[,.]+$", ""), F.lit(1), F.lit(240)).alias("author"),
            F.when(title != "", title).otherwise(F.substr(c["whole"], F.lit(1), F.lit(180))).alias("title"),
            F.when(kind == "article", journal).otherwise("").alias("journal"),
            booktitle.alias("booktitle"),
            F.when(kind == "misc", c["whole"]).otherwise("").alias("note"),
        )

    return let(let(tidy, of), fields)
