"""Line predicates: boolean columns over one line of text (and its box)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import contains_any, let, n_words, split_list, strip, words

MATH = r"=|[+*/^_]|(?<=[0-9)])\s*-\s*(?=[0-9A-Za-z(])|log|sqrt|×|−|≤|≥"
SYMBOLS = r"[γ√Σ∫]"


def is_title_noise(line: Column) -> Column:
    return let(
        strip(line),
        lambda s: (s == "")
        | contains_any(F.lower(s), K.TITLE_NOISE)
        | s.rlike(K.CONFERENCE_BANNER)
        | s.rlike(r"^\d{3,4}$|^(?i:(?:19|20)\d{2}\s+IEEE)|^978[-\d]+\s*©?\s*\d{4}\s+IEEE"),
    )


def is_affiliation(line: Column) -> Column:
    return contains_any(F.lower(strip(line)), K.AFFILIATION_LINE_HINTS)


def is_institution(line: Column) -> Column:
    return contains_any(F.lower(strip(line)), K.INSTITUTION_HINTS)


def _letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^A-Za-z]", ""))


def is_comma_location(line: Column) -> Column:
    def judged(parts: Column) -> Column:
        last = _letters(F.element_at(parts, -1))
        return (
            F.size(parts).between(2, 4)
            & ~F.exists(parts, is_affiliation)
            & (last.isin(K.COUNTRIES + K.STATES) | last.isin(K.PLACES))
            & F.forall(parts, lambda p: n_words(p).between(1, 3))
        )

    return F.when(F.contains(line, F.lit(",")) & ~line.rlike(r"[@\d]") & (F.size(split_list(line, ",")) > 0), let(split_list(line, ","), judged)).otherwise(False)


def is_location(line: Column) -> Column:
    """A place.  Any line of a single word counts as one."""
    plain = lambda s: F.filter(F.transform(words(s), lambda w: _letters(w)), lambda w: w != "")
    return let(
        strip(line),
        lambda s: F.when(s == "", F.lit(False)).otherwise(
            F.lower(s).isin(K.REGIONS)
            | let(plain(s), lambda p: (F.size(p) == 1) | ((F.size(p) > 0) & F.forall(p, lambda w: w.isin(K.PLACES))))
            | is_comma_location(s)
        ),
    )


def is_name_token(token: Column) -> Column:
    return F.regexp_replace(token, r"^[,;:]+|[,;:]+$", "").rlike(r"^(?:[A-Z]\.|[A-Z][A-Za-z'\-]*)$")


def is_authors(line: Column) -> Column:
    """One capitalised name of two to five words, or several separated by commas or "and"."""
    name = lambda c: let(words(c), lambda w: F.size(w).between(2, 5) & F.forall(w, is_name_token))
    listed = lambda s: let(
        split_list(s, r",|\band\b"),
        lambda ps: (F.size(ps) >= 2) & F.forall(ps, lambda p: name(p) & ~is_affiliation(p) & ~is_location(p)),
    )
    return let(
        strip(line),
        lambda s: F.when((s == "") | (F.length(s) > 200) | s.rlike(r"[@\d]") | is_affiliation(s), False)
        .when(name(s) | listed(s), ~is_location(s))
        .otherwise(False),
    )


def _prose(line: Column, least: int, low: int, share: int) -> Column:
    """At least ``least`` words, of which ``low`` and one in ``share`` have a small letter."""
    small = lambda w: F.size(F.filter(w, lambda x: x.rlike(r"\p{Ll}")))
    return let(words(line), lambda w: (F.size(w) >= least) & (small(w) >= F.greatest(F.lit(low), F.floor(F.size(w) / share))))


def is_body_paragraph(line: Column) -> Column:
    return _prose(line, 10, 4, 2)


def is_body_line(line: Column) -> Column:
    return _prose(line, 6, 3, 3)


def is_table_data(line: Column) -> Column:
    s = strip(line)
    return s.rlike(r"\(\s*-?\d") | ((F.regexp_count(s, F.lit(r"\d")) >= 4) & (n_words(s) <= 12))


def is_reference_lead(line: Column) -> Column:
    return line.rlike(r"^\[\d+\]|^\d+[.)]\s+|^(?:[A-Z]\.\s*){1,3}[A-Z][A-Za-z'-]+")


def is_subsection(line: Column) -> Column:
    return line.rlike(r"^[A-Z]\.\s+[A-Z]")


def is_skipped_in_section(line: Column) -> Column:
    return strip(line).rlike(r"^$|^\d{1,3}$|^(?:19|20)\d{2}$")


def is_header_footer(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(K.HEADER_FOOTER)) | ((F.length(line) >= 10) & line.rlike(K.FOOTER_LINES))


def is_not_figure(line: Column) -> Column:
    s = strip(line)
    return (
        (s == "")
        | s.rlike(r"(?i)^(?:Fig\.?|Figure)\s*\d+")
        | s.rlike(r"(?i)^(?:[A-Z]\.\s+[A-Z]|[IVX]+\.\s+[A-Z]|TABLE\s+[IVXLC0-9]+|REFERENCES$)")
        | s.rlike(r"(?i)Authorized licensed use|Downloaded on|IEEE .*Conference")
        | is_body_paragraph(s)
    )


def _centred(x0: Column, x1: Column, width: Column) -> Column:
    return F.abs((x0 + x1) / 2 - width / 2) < width * 0.18


def is_equation_line(line: Column, x0: Column, x1: Column, width: Column) -> Column:
    s = strip(line)
    shape = F.length(s).between(3, 120) & ~s.endswith(".") & ~is_body_paragraph(s)
    place = _centred(x0, x1, width) | ((x1 - x0) < width * 0.7)
    lead = F.lower(s).rlike(r"^(?:where |table |actual |estimated |difference )")
    wordy = (n_words(s) > 4) & ~F.contains(s, F.lit("=")) & ~s.rlike(r"[\d()]")
    numbers = F.contains(s, F.lit("=")) & (F.regexp_count(s, F.lit(r"\d+")) >= 5) & ~s.rlike(r"[+*/()]")
    run = r"[A-Za-z0-9)]\s*[+*/=]\s*[A-Za-z0-9(]"
    return shape & place & ~lead & ~wordy & ~numbers & s.rlike(f"{MATH}|{SYMBOLS}|{run}")


def is_equation_satellite(line: Column, x0: Column, x1: Column, width: Column) -> Column:
    s = strip(line)
    shape = F.length(s).between(1, 48) & ~s.endswith(".")
    place = _centred(x0, x1, width) | ((x1 - x0) < width * 0.55)
    token = s.rlike(r"^(?:\(\d+\)|[A-Za-z]\d*|\d+)$")
    wordy = is_body_paragraph(s) | ((n_words(s) > 4) & ~s.rlike(r"[\d()]")) | (n_words(s) > 6)
    return shape & place & (token | (~wordy & s.rlike(f"{MATH}|{SYMBOLS}")))


def column_bucket(x0: Column, x1: Column, width: Column) -> Column:
    centre = (x0 + x1) / 2
    return F.when(centre < width * 0.43, "left").when(centre > width * 0.57, "right").otherwise("center")


def horizontally_related(ax0: Column, ax1: Column, bx0: Column, bx1: Column, width: Column) -> Column:
    near = F.abs((ax0 + ax1) / 2 - (bx0 + bx1) / 2) <= width * 0.18
    overlap = (ax1 >= bx0 - 24) & (ax0 <= bx1 + 84)
    return near | overlap | (column_bucket(ax0, ax1, width) == column_bucket(bx0, bx1, width))


def in_figure_band(y0: Column, y1: Column, x0: Column, x1: Column, top: Column, bottom: Column, column: Column, width: Column) -> Column:
    return (y1 >= top) & (y0 <= bottom) & ((column == "center") | (column_bucket(x0, x1, width) == column))
