"""Theses: title, author, abstract, chapters and references of extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, heading, let, lines_of, n_words, strip, strip_reference_noise
from .pdf_text import reference_entries

# Front matter that is cut, and what a body starts with.
FRONT_BLOCKS = ["TABLE OF CONTENTS", "LIST OF FIGURES", "LIST OF TABLES", "LIST OF ABBREVIATIONS", "LIST OF SYMBOLS", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "DEDICATION"]
ABSTRACT_STOPS = ["DEDICATION", "TABLE OF CONTENTS", "ACKNOWLEDGMENTS", "CHAPTER 1", "CHAPTER I"]
STARTS = [r"chapter\s+1\s+introduction", r"chapter\s+i\s+introduction", r"chapter\s+1\b", r"chapter\s+i\b", r"\n\s*1\.\s+introduction\b"]
CHAPTER = r"CHAPTER\s+(?:\d+|[IVXL]+)\s+[A-Z][A-Z\s\-/]+"
MOST_REFERENCES = 200


def title(c: Column) -> Column:
    named = collapse(F.regexp_extract(c, r"(?is)entitled\s+(.*?)\s+(?:be\s+accepted|is\s+approved|is\s+presented|has\s+been\s+accepted)", 1))
    lines = F.slice(F.filter(F.transform(lines_of(c), lambda x: strip(x)), lambda x: x != ""), 1, 40)
    first = F.get(F.filter(lines, lambda x: (n_words(x) > 4) & (F.length(x) < 200)), 0)
    return F.when(named != "", named).otherwise(F.coalesce(collapse(first), F.lit("Untitled Thesis")))


def author(c: Column) -> Column:
    named = F.regexp_extract(c, r"(?is)(?:prepared|submitted|presented)\s+by\s+([A-Z][A-Za-z\s.,'-]+?)\s+(?:entitled|in\s+partial|for\s+the\s+degree)", 1)
    plain = F.regexp_extract(F.substring(c, 1, 4000), r"\bby\s+([A-Z][A-Za-z.\- ]{4,60})", 1)
    return F.when(named != "", strip(F.regexp_replace(collapse(named), ",.*$", ""))).otherwise(collapse(plain))


def abstract(c: Column) -> Column:
    """Up to the next front block.  Words of roman letters go, as page numbers do."""
    block = F.regexp_extract(c, rf"(?is)ABSTRACT\s+(.*?)(?:{'|'.join(ABSTRACT_STOPS)})", 1)
    return collapse(F.regexp_replace(block, r"(?i)\b[ivxlcdm]+\b", " "))


def strip_front(c: Column) -> Column:
    for name in FRONT_BLOCKS:
        c = F.regexp_replace(c, rf"(?is){name}.*?(?=CHAPTER\s+(?:\d+|[IVXL]+)\b|\z)", " ")
    c = F.regexp_replace(c, r"\.{5,}\s*\d+", " ")
    c = F.regexp_replace(c, r"(?:\b\d+(?:\.\d+)+\s+[A-Z][A-Za-z\-\s]{3,60}?(?=(?:\s+\d+(?:\.\d+)+\s+[A-Z])|$)){3,}", " ")
    return F.regexp_replace(c, r"(?i)\b[ivxlcdm]+\b", " ")


def body(c: Column) -> Column:
    """From the first chapter mark that no table of contents entry follows."""
    real = r"(?!.{0,60}?(?:\.{3,}\s*\d+|\s+\d+\.\d+\s+[A-Z]))"
    found = [F.nullif(F.regexp_instr(c, F.lit(f"(?s)(?i:{p}){real}")), F.lit(0)) for p in STARTS]
    start = F.coalesce(*found, F.nullif(F.regexp_instr(c, F.lit(r"(?i)\bintroduction\b")), F.lit(0)), F.lit(1))
    return F.regexp_replace(F.substr(c, start), r"(?is)APPENDI(?:X|CES)\s+[A-Z].*", "")


def chapters(c: Column) -> Column:
    """Array of (title, content); the first of equal titles counts, short ones go,
    and a text without any is one "Body"."""

    def one(p: Column) -> Column:
        head = F.regexp_extract(p, f"^{CHAPTER}", 0)
        name = F.regexp_replace(heading(F.regexp_replace(head, r"^CHAPTER\s+(?:\d+|[IVXL]+)\s+", "")), r"\s*\b[A-Z]$", "")
        t = collapse(F.substr(p, F.length(head) + 1))
        t = F.regexp_replace(t, r"\b\d+(?:\.\d+)+\s+[A-Z][A-Za-z].{0,60}", " ")
        t = F.regexp_replace(t, r"(?i)\b(?:Figure|Fig\.|Table)\s+\d+[\-\d:.]*.*?(?=\.|\n)", " ")
        return F.struct(name.alias("title"), collapse(t).alias("content"))

    parts = F.filter(F.split(c, f"(?={CHAPTER})"), lambda p: p.rlike(f"^{CHAPTER}"))
    long_ = F.filter(F.transform(parts, one), lambda s: (F.length(s["content"]) >= 150) & (s["title"] != ""))
    firsts = let(long_, lambda a: F.filter(a, lambda s, i: F.array_position(F.transform(a, lambda x: x["title"]), s["title"]) == i + 1))
    return let(firsts, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.struct(F.lit("Body").alias("title"), collapse(c).alias("content")))))


def references(c: Column) -> Column:
    """Bracketed entries behind the last bibliography mark, of 20 characters or more."""
    tail = F.regexp_extract(c, r"(?is)^.*(?:REFERENCES|BIBLIOGRAPHY|WORKS\s+CITED)(.*)$", 1)
    found = F.filter(reference_entries(strip_reference_noise(tail)), lambda r: F.length(r["raw"]) >= 20)
    return F.slice(found, 1, MOST_REFERENCES)
