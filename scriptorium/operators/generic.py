"""Generic articles from structure summaries, and the preamble that a body needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, strip
from . import structure

# Marks in a body (regular expressions) and the preamble lines they need.
BODY_NEEDS = [
    (r"\\(?:begin|end)\{subfigure\}", [r"\usepackage{subcaption}"]),
    (r"\\subfloat", [r"\usepackage{subfig}"]),
    (r"\\(?:begin|end)\{tikzpicture\}|\\begin\{scope\}", [r"\usepackage{tikz}"]),
    (r"\\begin\{axis\}|\\pgfplotsset", [r"\usepackage{pgfplots}", r"\pgfplotsset{compat=1.18}"]),
    (r"\\begin\{venndiagram", [r"\usepackage{venndiagram}"]),
    (r"\\(?:begin|end)\{enumerate\*\}", [r"\usepackage[inline]{enumitem}"]),
    (r"\\(?:top|mid|bottom)rule", [r"\usepackage{booktabs}"]),
    (r"\\multirow", [r"\usepackage{multirow}"]),
    (r"\\multicolumn", [r"\usepackage{multicol}"]),
    (r"\\captionof\{", [r"\usepackage{caption}"]),
    (r"\\Circle|\\CIRCLE", [r"\usepackage{wasysym}"]),
    (r"\\balance", [r"\usepackage{balance}"]),
    (r"\\begin\{lstlisting\}|\\lstinputlisting", [r"\usepackage{listings}"]),
    (r"\\begin\{algorithm(?:ic)?\}", [r"\usepackage{algorithm}", r"\usepackage{algpseudocode}"]),
    (r"\\xspace", [r"\usepackage{xspace}"]),
    (r"\\url\{|\\href\{", [r"\usepackage{hyperref}"]),
    (r"\\textcolor\{|\\colorbox\{|\\definecolor\{", [r"\usepackage{xcolor}"]),
    (r"\\hologo\{", [r"\usepackage{hologo}"]),
]
# Packages of a source that may be passed on.
FORWARDED = [
    "algorithm", "algpseudocode", "algorithmicx", "listings", "listingsutf8", "xcolor", "color", "hyperref", "url", "xspace", "booktabs", "multirow", "multicol",
    "subcaption", "subfig", "caption", "tikz", "pgfplots", "enumitem", "wasysym", "amssymb", "amsthm", "natbib", "cite", "tabularx", "longtable", "array",
    "rotating", "pdflscape", "minted", "verbatim", "cleveref", "hologo", "metalogo", "relsize", "scalefnt",
]
# Characters of plain text and how LaTeX writes them.
PLAIN = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "%": r"\%", "#": r"\#", "_": r"\_", "^": r"\textasciicircum{}", "~": r"\textasciitilde{}", "<": r"\textless{}", ">": r"\textgreater{}"}
LONGEST = 5000
STUB_BIB = "@article{unknown,\n  title={Unknown},\n  author={Unknown},\n  year={2024},\n  journal={Unknown}\n}\n"
LEVELS = {0: "part", 1: "section", 2: "subsection"}


def preamble_lines(body: Column, packages: Column, libraries: Column, roots: Column, macros: Column) -> Column:
    """Distinct preamble lines in order: what the body's marks need, source packages
    that may be passed on, libraries, the graphics path, macros."""
    none = F.array().cast("array<string>")
    inferred = [F.when(body.rlike(mark), F.array(*[F.lit(x) for x in lines])).otherwise(none) for mark, lines in BODY_NEEDS]
    passed = F.transform(F.array_intersect(packages, F.array(*[F.lit(p) for p in FORWARDED])), lambda p: F.concat(F.lit("\\usepackage{"), p, F.lit("}")))
    folder = F.transform(F.filter(roots, lambda r: strip(r) != ""), lambda r: F.concat(F.lit("{"), F.regexp_replace(strip(r), "/*$", ""), F.lit("/"), F.lit("}")))
    path = F.when(F.size(folder) > 0, F.array(F.concat(F.lit("\\graphicspath{"), F.array_join(folder, ""), F.lit("}")))).otherwise(none)
    return F.array_distinct(F.concat(*inferred, passed, libraries, path, macros))


def sanitize(c: Column) -> Column:
    """Plain text for LaTeX, white space collapsed, 5000 characters at most.

    Commands with a group and inline math are kept as they are: the text is split
    around them, and only what lies between is escaped.
    """
    parts = F.regexp_extract_all(collapse(c), F.lit(r"(\\[a-zA-Z]+\{[^}]*\}|\$[^$]*\$|[^\\$]+|[\\$])"), 1)
    escaped = lambda p: F.array_join(
        F.transform(F.split(p, ""), lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in PLAIN.items() for y in kv]), x), x)), ""
    )
    kept = lambda p: p.rlike(r"^(?:\\[a-zA-Z]+\{[^}]*\}|\$[^$]*\$)$")
    return F.substring(F.array_join(F.transform(parts, lambda p: F.when(kept(p), p).otherwise(escaped(p))), ""), 1, LONGEST)


def list_block(one: Column) -> Column:
    """A list (kind, items) as an environment; 50 items at most."""
    env = F.when(one["kind"] == "numbered", "enumerate").otherwise("itemize")
    items = F.transform(F.slice(one["items"], 1, 50), lambda i: F.concat(F.lit("  \\item "), sanitize(i), F.lit("\n")))
    return F.concat(F.lit("\\begin{"), env, F.lit("}\n"), F.array_join(items, ""), F.lit("\\end{"), env, F.lit("}\n"))


def table_block(one: Column) -> Column:
    """A table (rows of tab-separated cells) as an environment: as wide as its first
    row, short rows filled and long ones cut, 20 rows at most."""
    rows = F.transform(F.slice(one["items"], 1, 20), lambda r: F.split(r, "\t"))
    width = F.size(F.split(F.get(one["items"], 0), "\t"))
    row = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(sanitize(F.get(r, i)), F.lit(""))), " & ")
    lines = F.transform(rows, lambda r, i: F.concat(row(r), F.lit(" \\\\\n"), F.when((i == 0) & (F.size(rows) > 1), F.lit("\\midrule\n")).otherwise(F.lit(""))))
    return F.concat(
        F.lit("\\begin{table}[h]\n\\centering\n\\begin{tabular}{"), F.array_join(F.array_repeat(F.lit("c"), width), " | "), F.lit("}\n\\toprule\n"),
        F.array_join(lines, ""), F.lit("\\bottomrule\n\\end{tabular}\n\\end{table}\n\n"),
    )


def article(c: Column, name: Column) -> Column:
    """A generic article of a text: its sections, with the first three lists and
    tables once behind them; without sections, the first twenty paragraphs.  A text of
    under 50 characters becomes one line that names its source."""
    t = F.when(F.length(strip(c)) < 50, F.concat(F.lit("[Content extracted from: "), name, F.lit("]"))).otherwise(c)
    shared = F.concat(
        F.array_join(F.transform(F.slice(structure.lists(t), 1, 3), list_block), "\n"), F.array_join(F.transform(F.slice(structure.tables(t), 1, 3), table_block), "\n")
    )
    command = lambda level: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in LEVELS.items() for y in kv]), level), F.lit("subsubsection"))
    sections = F.transform(
        structure.sections(t), lambda s: F.concat(F.lit("\\"), command(s["level"]), F.lit("{"), sanitize(s["title"]), F.lit("}\n\n"))
    )
    plain = F.array_join(F.transform(F.slice(structure.paragraphs(t), 1, 20), lambda p: sanitize(p)), "\n\n")
    body = F.when(F.size(sections) > 0, F.concat(F.array_join(sections, ""), shared)).otherwise(plain)
    return F.concat(
        F.lit("\\documentclass{article}\n\\usepackage{booktabs}\n\\begin{document}\n\\title{"), sanitize(name), F.lit("}\n\\maketitle\n"), body, F.lit("\n\\end{document}\n")
    )

