"""Operators on small inputs, with the values they should give."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import predicates as P
from scriptorium.functions import text as T
from scriptorium.operators import artifacts, convert, generic, latex, layout, pdf_text, references, stateful, structure, thesis
from scriptorium.plans import pipeline
from scriptorium.sources import projects
from scriptorium.streaming import jobs


def value(spark, expression, text=""):
    return spark.createDataFrame([(text,)], "t string").select(expression.alias("x")).first()["x"]


T_ = None


@pytest.fixture(autouse=True)
def text_column(spark):
    """The column that expressions are tried on; columns need a session."""
    global T_
    T_ = F.col("t")

LATEX = r"""\documentclass[conference]{IEEEtran}
\usepackage[x]{xcolor, graphicx}
\begin{document}
\title{A  Test of Things}
\author{Ann Lee, Bo Ray \and Cy Poe}
\begin{abstract}Short.\end{abstract}
\begin{IEEEkeywords}one, two; three\end{IEEEkeywords}
\section{Introduction}
See \cite{a,b} and Fig.~\ref{fig:one}. 100\% sure.
\section{Conclusion}
Done.
\bibliography{references}
\end{document}
"""


def test_latex_record(spark):
    r = latex.parse(spark.createDataFrame([(LATEX,), (None,)], "latex string")).collect()
    a, b = r
    assert (a.title, a.authors, a.abstract, a.keywords) == ("A  Test of Things", ["Ann Lee", "Bo Ray", "Cy Poe"], "Short.", ["one", "two", "three"])
    assert [(s.ord, s.title, s.content) for s in a.sections] == [(0, "Introduction", "See \\cite{a,b} and Fig.~\\ref{fig:one}. 100\\% sure."), (1, "Conclusion", "Done.")]
    assert a.source_packages == ["xcolor"]
    assert (b.title, b.authors, b.sections, b.abstract) == ("Untitled", [], [], "")


@pytest.mark.parametrize("source,warnings", [("ieee", []), ("acm", ["class of ieee", "no class of acm"])])
def test_format_guard(spark, source, warnings):
    assert value(spark, latex.format_guard(T_, source), LATEX) == warnings


def test_citations(spark):
    known = F.array(F.lit("a"))
    assert tuple(value(spark, latex.citation_status(T_, known), LATEX)) == ("pass", ["b"])
    assert tuple(value(spark, latex.citation_status(T_, F.array(F.lit("z"))), LATEX)) == ("warn", ["a", "b"])
    assert value(spark, latex.unresolved_refs(T_, "fig:"), LATEX) == ["fig:one"]


def test_direction(spark):
    assert value(spark, convert.route(F.lit("IEEE"), F.lit("acm"))) == "ieee->acm"
    with pytest.raises(Exception, match="unsupported direction"):
        value(spark, convert.route(T_, F.lit("ieee")), "ieee")


def test_conversion_keeps_citations(spark):
    refs = "array(struct('a' AS key, '@article{a, title={X}}' AS raw), struct('b' AS key, 'B. Other, {Odd}' AS raw), struct('a' AS key, 'later' AS raw))"
    p = spark.createDataFrame([(1, LATEX)], "doc_id long, latex string").withColumn("references", F.expr(refs))
    r = pipeline.convert_latex(p, "ieee").first()
    assert r.status == "success" and "{acmart}" in r.main_tex and "\\cite{a,b}" in r.main_tex and "\\keywords{one, two, three}" in r.main_tex
    assert r.main_tex.index("\\maketitle") > r.main_tex.index("\\end{abstract}")
    assert r.main_tex.count("\\author{") == 3 and "A Test of Things" in r.main_tex
    assert r.bib == "@article{a, title={X}}\n\n@misc{b,\n  note={B. Other, (Odd)},\n}\n"
    assert r.validation.template == "pass" and "figure refs" in r.validation.warnings and r.validation.errors == []
    assert r["items"] == ["affiliations", "conference"]
    hooked = pipeline.convert_latex(p, "ieee", compiled=F.lit("failed"), hook=lambda c: F.replace(c, F.lit("\\end{document}"), F.lit(""))).first()
    assert hooked.status == "failed" and "no end" in hooked.validation.errors


def test_written_projects(spark, tmp_path):
    p = spark.createDataFrame([(1, LATEX)], "doc_id long, latex string")
    pipeline.write_projects(pipeline.convert_latex(p, "ieee"), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).filter("name = 'main.tex'").first()
    assert back.value.strip().endswith("\\end{document}")


def test_repair(spark):
    two = "\\begin{document}x\\end{document}\ny\\end{document}"
    assert value(spark, convert.repair(T_, 0), two) == "\\usepackage{graphicx}\n\\begin{document}x\\end{document}\n"
    bib = "\\bibliography{references}\na\n\\bibliography{references}\n\\bibliographystyle{p}\\end{document}"
    assert value(spark, convert.repair(T_, 1), bib) == "a\n\\bibliography{references}\n\\bibliographystyle{p}\\end{document}"
    assert value(spark, convert.harmonize(T_), "a\r\nb\n\n\n\nc") == "a\nb\n\n\nc"


@pytest.mark.parametrize(
    "raw,escaped",
    [("5% of $x_1 & y#", r"5\% of \$x\_1 \& y\#"), (r"done \% \_", r"done \% \_"), ("a~b^c", r"a\~{}b\^{}c"), ("", "")],
)
def test_escape(spark, raw, escaped):
    assert value(spark, T.escape_latex(T_), raw) == escaped


@pytest.mark.parametrize(
    "test,line,expected",
    [
        (P.is_title_noise, "2023 IEEE Conference on Things", True),
        (P.is_title_noise, "A Plain Title of Work", False),
        (P.is_title_noise, "Copyright 2020", True),
        (P.is_authors, "Ann Lee", True),
        (P.is_authors, "Ann B. Lee, Bo Ray and Cy Poe", True),
        (P.is_authors, "Department of Physics", False),
        (P.is_authors, "Greensboro, North Carolina, USA", False),
        (P.is_location, "Greensboro", True),
        (P.is_location, "North Carolina", True),
        (P.is_location, "Springfield, NC", True),
        (P.is_location, "Two Words", False),
        (P.is_body_paragraph, "this is a line of ten words that reads like prose", True),
        (P.is_body_line, "Six words are here in line", True),
        (P.is_table_data, "12 34 (5)", True),
        (P.is_table_data, "no digits", False),
        (P.is_reference_lead, "[12] A. Author", True),
        (P.is_subsection, "A. Design", True),
        (P.is_skipped_in_section, "2019", True),
        (P.is_header_footer, "3 / 12345678", True),
        (P.is_header_footer, "Downloaded on May 1 UTC from IEEE Xplore.", True),
        (P.is_not_figure, "Fig. 3 shows", True),
    ],
)
def test_line_predicates(spark, test, line, expected):
    assert value(spark, test(T_), line) is expected


@pytest.mark.parametrize("line,x0,x1,expected", [("d = a * b + c", 200.0, 400.0, True), ("where x = 3", 200.0, 400.0, False), ("Plain text here.", 0.0, 600.0, False), ("(3)", 500.0, 520.0, False)])
def test_equation_line(spark, line, x0, x1, expected):
    assert value(spark, P.is_equation_line(T_, F.lit(x0), F.lit(x1), F.lit(600.0)), line) is expected


def test_repeated_front_line_keeps_its_first_copy(spark):
    long = "A repeated line of more than thirty characters"
    text = f"{long}\n{long}\nshort line\nshort line\nAbstract\n{long}\nend"
    assert value(spark, pdf_text.keep_lines(T_), text) == [long, "short line", "short line", "Abstract", "end"]


def test_sections_of_extracted_text(spark):
    text = (
        "Title\nI. INTRODUCTION\nD IGITAL work is a long enough line to be kept as a body here.\n\nSecond paragraph is here too.\n"
        "Related Work\nthis line of prose follows the plain heading above it\nand goes on with more words.\nREFERENCES\n[1] A. Author, Some title, 2001."
    )
    got = [(s.title, s.content) for s in value(spark, pdf_text.sections(T_), text)]
    assert got == [
        ("Introduction", "Digital work is a long enough line to be kept as a body here.\n\nSecond paragraph is here too."),
        ("Related Work", "this line of prose follows the plain heading above it and goes on with more words."),
        ("References", "[1] A. Author, Some title, 2001."),
    ]
    assert [s.title for s in value(spark, pdf_text.sections(T_), "only one chunk of text")] == ["Body"]
    assert value(spark, pdf_text.sections(T_), None) == []


def test_front_matter(spark):
    text = "IEEE INFOCOM 2020\nA Study of Many\nUseful Things in Practice\nAnn Lee\nAbstract - words\nIndex Terms - a; b\nI. INTRODUCTION\nx"
    assert value(spark, pdf_text.title_of(T_), text) == "A Study of Many Useful Things in Practice"
    assert value(spark, pdf_text.abstract(T_), text) == "words" and value(spark, pdf_text.keywords(T_), text) == ["a", "b"]
    lines = F.array(*[F.lit(x) for x in ("Ann Lee", "Department of Physics", "Example University", "Springfield, NC", "ann@x.org", "Bo Ray", "Other Institute", "bo@y.org")])
    got = value(spark, pdf_text.author_profiles(lines))
    assert [tuple(p) for p in got] == [("Ann Lee", "Department of Physics", "Example University", "Springfield, NC", "ann@x.org"), ("Bo Ray", None, "Other Institute", None, "bo@y.org")]


def test_document_type(spark):
    kind = lambda t: value(spark, pdf_text.document_type(T_), t)["kind"]
    assert kind("a thesis and dissertation for the graduate school") == "thesis_dissertation"
    assert kind("Index Terms here") == "ieee_paper" and kind("an ACM paper") == "acm_paper" and kind(None) == "generic_academic_pdf"


def test_captions_and_citations(spark):
    text = "as shown. Fig. 2. Overview of the Whole Design\nFigure 3 we observe that things hold\nTABLE IV Results of all our runs"
    assert [tuple(c) for c in value(spark, pdf_text.captions(T_, "figure"), text)] == [("fig:2", "Overview of the Whole Design")]
    assert [tuple(c) for c in value(spark, pdf_text.captions(T_, "table"), text)] == [("tab:iv", "Results of all our runs")]
    known = F.array(F.lit("ref1"))
    assert value(spark, pdf_text.bracket_citations(T_, known), "x [1], [2] and [a]. [1]") == "x \\cite{ref1}, [2] and [a]. \\cite{ref1}"
    f = value(spark, pdf_text.citation_fields(T_), 'A. B, "Title," in Proceedings of X, vol. 3, no. 4, pp. 5–9, 2011.')
    assert tuple(f) == ("inproceedings", "2011", "3", "4", "5-9", "Title,")


def test_references_are_separated(spark):
    sec = lambda t, c: F.struct(F.lit(t).alias("title"), F.lit(c).alias("content"))
    ref = "[1] A. Author, Title of work, 2001. [2] B. Other, Another title, 2002."
    r = value(spark, references.separate_references(F.array(sec("Intro", "We use references to prose."), sec("Conclusion", f"It ends. REFERENCES {ref}"))))
    assert [(s.title, s.content) for s in r.sections] == [("Intro", "We use references to prose."), ("Conclusion", "It ends."), ("References", ref)]
    assert [x.key for x in r.references] == ["ref1", "ref2"]
    assert value(spark, references.separate_references(F.lit(None).cast("array<struct<title:string,content:string>>"))).sections == []


@pytest.mark.parametrize(
    "text,marked",
    [
        ("A. Data Model The body", "\\subsection{Data Model} The body"),
        ("x B. One two three four five six", "x \\subsection{One two three four} five six"),
        ("C. Word", "Word"),
        ("no mark", "no mark"),
    ],
)
def test_subsections(spark, text, marked):
    assert value(spark, stateful.mark_subsections(T_), text) == marked


def test_macros(spark):
    pre = "\\newcommand*{\\a}[2][x]{b {c}%note\n d}\n% \\newcommand{\\no}{}\n\\def\\q{1}\n\\let\\old=\\new\n\\renewcommand{\\title}{z}\n\\newcommand{\\open}{"
    assert value(spark, stateful.custom_macros(T_), pre) == ["\\newcommand*{\\a}[2][x]{b {c} d}", "\\def\\q{1}", "\\let\\old=\\new", "\\newcommand{\\open}"]


@pytest.mark.parametrize(
    "raw,author,title",
    [
        ('A. Lee and B. Ray, "On things," in Proc. X, 2001.', "A. Lee and B. Ray", "On things"),
        ("A. Lee, B. Ray and co. On things that matter. Journal of Work, 2001.", "A. Lee, B. Ray and co", "On things that matter"),
    ],
)
def test_citation_split(spark, raw, author, title):
    got = value(spark, references.split_citation(T_), raw)
    assert (got.author, got.title) == (author, title)


def test_citation_venues(spark):
    got = value(spark, references.split_citation(T_), 'A. Lee, "On things," in Proc. X Conf., vol. 2, 2001.')
    assert (got.kind, got.booktitle, got.journal, got.note) == ("inproceedings", "Proc. X Conf.", "", "")
    got = value(spark, references.split_citation(T_), 'A. Lee, "On things," IEEE Transactions on Work, vol. 2, 2001.')
    assert (got.kind, got.booktitle, got.journal) == ("article", "", "IEEE Transactions on Work")
    got = value(spark, references.split_citation(T_), "Some page, accessed 2001")
    assert (got.kind, got.note) == ("misc", "Some page, accessed")


def test_continued_references(spark):
    sec = lambda t, c: F.struct(F.lit(t).alias("title"), F.lit(c).alias("content"))
    arr = F.array(
        sec("Introduction", "In text, see the work."),
        sec("References", "[1] A. Author, Title of the first, Journal, 2001."),
        sec("More", "[2] B. Other, Some paper title, in Proceedings, 2010. [2] B. Other, Some later paper title, 2011."),
        sec("Appendix", "Plain words."),
    )
    r = value(spark, references.separate_references(arr))
    assert [s.title for s in r.sections] == ["Introduction", "References", "Appendix"] and r.sections[1].content.endswith("title, 2011.")
    assert [(x.key, x.raw[-5:]) for x in r.references] == [("ref1", "2001."), ("ref2", "2011.")]


def test_job_clock_and_list(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, "a", at(0), "queued", "wait"), (2, "a", at(5), "running", "parse"), (3, "a", at(6), "running", "parse"), (4, "a", at(9), "running", "render"), (5, "b", at(1), "queued", "wait"), (6, "c", at(7), "completed", "done")]
    events = spark.createDataFrame([(*r, 600) for r in rows], "event_id long, job_id string, ts timestamp, status string, stage string, timeout_seconds int")
    got = jobs.latest(events)
    assert {r.job_id: r.started_at for r in got.collect()} == {"a": at(5), "b": at(1), "c": at(7)}
    assert [r.job_id for r in jobs.listing(got).collect()] == ["a", "c", "b"]
    assert sorted((r.job_id, r.seq, r.stage, r.left_at) for r in jobs.timeline(events.filter("job_id = 'a'")).collect()) == [("a", 1, "wait", at(5)), ("a", 2, "parse", at(9)), ("a", 3, "render", None)]
    ended = jobs.worker_exit(got, spark.createDataFrame([("a", 1), ("c", 1)], "job_id string, exit_code int"))
    assert {r.job_id: (r.status, r.failure_kind) for r in ended.collect()} == {"a": ("failed", "worker_exit"), "b": ("queued", None), "c": ("completed", None)}


def test_placeholders(spark):
    keys = lambda t: [tuple(r) for r in value(spark, stateful.reference_placeholders(T_), t)]
    assert keys("x [2] y [1] [2]") == [("ref2", "placeholder for ref2"), ("ref1", "placeholder for ref1")]
    assert keys("a [9]\nReferences\n[1] First one\nhere [1] again [2] two") == [("ref1", "First one here"), ("ref2", "two")]


def test_projects(spark):
    files = spark.createDataFrame(
        [
            ("p", "z.tex", "\\begin{document}\\input{parts/one}\\include{gone}\\end{document}"),
            ("p", "a.tex", "none"),
            ("p", "parts/one.tex", "1\\input{two.tex}"),
            ("p", "parts/two.tex", "2\\input{one}"),
            ("q", "deep/main.tex", "x"),
        ],
        "project string, rel_path string, content string",
    )
    entries = projects.entry_files(files)
    assert {(r.project, r.rel_path) for r in entries.collect()} == {("p", "z.tex"), ("q", "deep/main.tex")}
    got = {r.project: r.text for r in projects.inline_includes(files, entries).collect()}
    assert got == {"p": "\\begin{document}12\\include{gone}\\end{document}", "q": "x"}
    bib = "@a{k, t={x {y}}} @b{ m , z={1}}\n@c{nokey} @d{open, {"
    assert [r.key for r in value(spark, projects.bib_entries(T_), bib)] == ["k", "m"]
    assert [r.key for r in value(spark, projects.flat_bib_entries(T_), bib)] == ["k", "m"]


def test_projects_are_read_from_files(spark, tmp_path):
    (tmp_path / "p" / "figs").mkdir(parents=True)
    (tmp_path / "p" / "main.tex").write_text("x\ny")
    (tmp_path / "p" / "figs" / "a.png").write_bytes(b"1")
    got = projects.read_projects(spark, str(tmp_path)).collect()
    assert [(r.project, r.rel_path, r.content) for r in got] == [("p", "main.tex", "x\ny")]
    sizes = {r.suffix: r.size_bytes for r in projects.inventory(spark, str(tmp_path)).collect()}
    assert sizes == {".tex": 3, ".png": 1}


def lines(spark, rows):
    return spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], "doc_id long, page long, ord long, text string, x0 double, y0 double, x1 double, y1 double")


def test_equation_region(spark):
    page = lines(
        spark,
        [("Prose above the formula that is long and ends here and has words.", 40.0, 10.0, 560.0, 20.0), ("d = sqrt(a + b)", 250.0, 30.0, 350.0, 40.0), ("(4)", 400.0, 32.0, 420.0, 40.0), ("Prose below it that is long and ends here and has many words.", 40.0, 90.0, 560.0, 100.0), ("x = 1", 250.0, 300.0, 300.0, 310.0)],
    )
    got = layout.equation_regions(page, 600.0).collect()
    assert [(r["first"], r.n_lines, r.raw_text, r.x0, r.y1) for r in got] == [(1, 2, "d = sqrt(a + b) (4)", 250.0, 40.0)]


def test_figure_region_and_anchor(spark):
    page = lines(spark, [("Some text here", 40.0, 100.0, 200.0, 110.0), ("label", 60.0, 180.0, 120.0, 190.0), ("Fig. 1. A figure", 50.0, 250.0, 250.0, 260.0)])
    boxes = spark.createDataFrame([(1, 0, 50.0, 150.0, 240.0, 240.0), (1, 0, 400.0, 150.0, 500.0, 240.0)], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double")
    r = layout.figure_regions(page, boxes, 600.0).collect()
    assert [(x.c_ord, x.x0, x.y0, x.x1, x.y1) for x in r] == [(2, 36.0, 96.0, 274.0, 244.0)]
    anchors = {x.ord: x.anchor for x in layout.anchors(page, 600.0).collect()}
    assert anchors == {0: "", 1: "Some text here", 2: "Some text here label"}


def test_page_blocks(spark):
    rows = [(1, 0, [(0, [(["b", " c"], 5.0, 20.0, 9.0, 30.0), ([" "], 0.0, 0.0, 1.0, 1.0)]), (0, [(["a"], 5.0, 10.0, 9.0, 18.0)]), (1, [(["img"], 0.0, 0.0, 9.0, 9.0)])])]
    df = spark.createDataFrame(rows, "doc_id long, page long, blocks array<struct<type:int,lines:array<struct<spans:array<string>,x0:double,y0:double,x1:double,y1:double>>>>")
    assert [(r.ord, r.text) for r in layout.ordered_lines(df).orderBy("ord").collect()] == [(0, "a"), (1, "b c")]


def test_artifact_text(spark):
    lines_ = F.array(*[F.lit(x) for x in ("y =", "k", "a × (b)", "(7)")])
    assert value(spark, artifacts.linearize(lines_)) == "y = k a × (b) (7)"
    assert value(spark, artifacts.equation_number(lines_)) == "7"
    variants = value(spark, artifacts.scrub_variants(lines_))
    assert variants[0] == "y = k a × (b) (7)" and "y = k a x (b) (7)" in variants
    assert value(spark, artifacts.sentences(T_), "One. Two! Three") == ["One.", "Two!", "Three"]
    prose = "We see it. d = sqrt((x1 - x2)2 + (y1 - y2)2) + p (3). It holds (4) here."
    frame = spark.createDataFrame([(prose,), (None,)], "t string")
    assert [r.t for r in artifacts.remove_equation_residue(frame, "t").collect()] == ["We see it. . It holds (4) here.", None]
    assert value(spark, artifacts.remove_snippets(T_, F.array().cast("array<string>")), "a\n b") == "a\n b"
    assert value(spark, artifacts.remove_table_residue(T_), "x (1, 2) (3, 4) 5 ft y") == "x y"


def test_residue_takes_linear_time(spark):
    import time

    long = "Words before. d = sqrt((x1 - x2)2 + (y1 - y2)2) + p (3). And after it. " * 20000
    frame = spark.createDataFrame([(long,)], "t string")
    artifacts.remove_equation_residue(frame.limit(1).withColumn("t", F.substr("t", F.lit(1), F.lit(500))), "t").first()
    t = time.time()
    assert artifacts.remove_equation_residue(frame, "t").first().t == " ".join(["Words before. . And after it."] * 20000)
    assert time.time() - t < 5


def test_thesis(spark):
    text = (
        "TABLE OF CONTENTS\nCHAPTER 1 INTRODUCTION ........ 1\nCHAPTER 1 INTRODUCTION\n" + "Plain words of the first chapter go here. " * 8
        + "\nCHAPTER 2 METHODS\n" + "More plain words of the second chapter. " * 8 + "\nREFERENCES\n[1] A. Author, A long enough title, 2001."
    )
    got = value(spark, thesis.chapters(thesis.body(thesis.strip_front(T_))), text)
    assert [s.title for s in got] == ["Introduction", "Methods"]
    assert [r.key for r in value(spark, thesis.references(T_), text)] == ["ref1"]
    assert value(spark, thesis.title(T_), "") == "Untitled Thesis"


def test_structure(spark):
    text = "Page 1\nA Title of the Text\n\n- one\n- two\n1. first\n\na | b | c\nd | e | f\n\n1 Scope of Work\nx\nRESULTS OF TESTS\ny\nUnder Lined\n======\n"
    assert value(spark, structure.title(T_), text) == "A Title of the Text"
    assert [(x.kind, x["items"]) for x in value(spark, structure.lists(T_), text)] == [("bullet", ["one", "two"]), ("numbered", ["first"])]
    assert value(spark, structure.tables(T_), text) == []  # rows of ten characters or less are none
    assert [(x.title, x.level) for x in value(spark, structure.sections(T_), text)] == [("1 Scope of Work", 1), ("RESULTS OF TESTS", 1), ("Under Lined", 1)]


def test_visuals_merge(spark):
    t = spark.createDataFrame([(1, "fig:1", "A long caption", ""), (1, "fig:2", "Only text", "")], "doc_id long, label string, caption string, path string")
    p = spark.createDataFrame([(1, "fig:1", "Short", "p.png"), (1, "fig:3", "Only page", "q.png")], "doc_id long, label string, caption string, path string")
    got = {r.label: (r.caption, r.path, r.placement) for r in layout.merge_visuals(t, p).collect()}
    assert got == {"fig:1": ("Short", "p.png", "H"), "fig:2": ("Only text", "", "tbp"), "fig:3": ("Only page", "q.png", "tbp")}


def test_job_stream(spark, tmp_path):
    rows = "SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:00:00', 1L, 'queued', 's', 600), (1L, timestamp'2024-01-01 00:01:00', 2L, 'running', 's', 600), (2L, timestamp'2024-01-01 00:00:30', 3L, 'running', 's', 0) AS t(job_id, ts, event_id, status, stage, timeout_seconds)"
    spark.sql(rows).write.parquet(str(tmp_path / "in"))
    j = jobs.latest(spark.read.parquet(str(tmp_path / "in")))
    got = {r.job_id: (r.status, r.failure_kind) for r in jobs.reconcile(j, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}
    assert got == {1: ("failed", "timeout"), 2: ("running", None)}
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.run_available(stream, str(tmp_path / "ck"), lambda frame, epoch: seen.append(frame.count()))
    assert sum(seen) == 3
    state = jobs.stream_latest(stream).writeStream.outputMode("complete").format("memory").queryName("job_state").trigger(availableNow=True).start()
    state.awaitTermination()
    assert {r.job_id: r["last"].status for r in spark.table("job_state").collect()} == {1: "running", 2: "running"}


def test_generic_article(spark):
    assert value(spark, generic.sanitize(T_), "50% of  \\textbf{a_b} & $x_1$ {c} \\ _") == "50\\% of \\textbf{a_b} \\& $x_1$ \\{c\\} \\textbackslash{} \\_"
    text = "1 Scope of Work\nplain\n\n- one\n- two & more\n\nalpha | beta | gamma\nsome | rows\n\n"
    made = value(spark, generic.article(T_, F.lit("n_1")), text)
    assert "\\section{1 Scope of Work}" in made and "  \\item two \\& more\n" in made and "\\title{n\\_1}" in made
    assert "{c | c | c}\n\\toprule\nalpha & beta & gamma \\\\\n\\midrule\nsome & rows &  \\\\\n\\bottomrule" in made
