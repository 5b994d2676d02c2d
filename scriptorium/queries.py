"""Registered queries over whole tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import constants as K
from .functions import predicates as P
from .functions.text import collapse, escape_latex, heading, let, lines_of, n_words, normalise_artifact, repeated, strip, text
from .operators import artifacts, convert, generic, latex, layout, pdf_text, references, stateful, structure, thesis
from .plans import pipeline, synth
from .sources import projects
from .streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{m}", synth.CTE).replace("{lines}", synth.LINES_SQL)
        return f

    return register


def _docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def _refs() -> F.Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(synth.N_REFERENCES - 1)),
        lambda i: F.struct(F.concat(F.lit("ref"), i).alias("key"), F.concat(F.lit("@article{ref"), i, F.lit(", title={Work}}")).alias("raw")),
    )


def _records(spark, d) -> DataFrame:
    """Parsed LaTeX records with the fields that other readers would add."""
    none = F.array().cast("array<string>")
    visual = F.array().cast("array<struct<label:string,caption:string,path:string,placement:string>>")
    parsed = latex.parse(synth.manuscripts(spark, d))
    mail = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("a_"), F.col("doc_id"), F.lit("@x.org")))).otherwise(none)
    aff = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Uni A & B"), F.lit("Lab C"), F.lit("Inst D"), F.lit("Inst E"))).otherwise(none)
    return parsed.withColumns({"references": _refs(), "emails": mail, "affiliations": aff, "figures": visual, "tables": visual})


_STRIP = r"regexp_replace(X, '^\s+|\s+$', '', 'g')"


def _s(x: str) -> str:
    return _STRIP.replace("X", x)


_PARSE = rf"""
p AS (SELECT doc_id, latex,
  {_s(r"regexp_extract(latex, '(?s)\\title\{(.+?)\}', 1)")} AS title,
  list_filter(list_transform(regexp_split_to_array(regexp_extract(latex, '(?s)\\author\{{(.+?)\}}', 1), '\\and|,'), lambda x: {_s('x')}), lambda x: x <> '') AS authors,
  {_s(r"regexp_extract(latex, '(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}', 1)")} AS abstract,
  list_filter(list_transform(regexp_split_to_array(replace(CASE WHEN regexp_extract(latex, '(?s)\\keywords\{{(.+?)\}}', 1) <> '' THEN regexp_extract(latex, '(?s)\\keywords\{{(.+?)\}}', 1)
     ELSE regexp_extract(latex, '(?s)\\begin\{{IEEEkeywords\}}(.*?)\\end\{{IEEEkeywords\}}', 1) END, chr(10), ' '), '[,;]'), lambda x: {_s('x')}), lambda x: x <> '') AS keywords,
  {_s(r"regexp_extract(latex, '(?s)\\begin\{acks\}(.*?)\\end\{acks\}', 1)")} AS acknowledgments,
  regexp_extract_all(latex, '\\ccsdesc(?:\[[^\]]+\])?\{{([^}}]+)\}}', 1) AS ccs FROM m),
s AS (SELECT doc_id, u.i AS ord, {_s(r"regexp_extract(u.x, '^(.+?)\}', 1)")} AS title,
   {_s(r"regexp_split_to_array(substr(u.x, length(regexp_extract(u.x, '^(.+?)\}', 0)) + 1), '(?i)\\(?:bibliography|bibliographystyle|printbibliography|end\s*\{document\}|appendix)\b')[1]")} AS content
  FROM (SELECT doc_id, unnest(list_transform(string_split(latex, '\section{{')[2:], lambda x, i: {{'x': x, 'i': i - 1}})) AS u FROM m))
"""


@query("WITH {m}, " + _PARSE + "SELECT doc_id, title, array_to_string(authors, '|') AS authors, abstract, array_to_string(keywords, '|') AS keywords, acknowledgments, array_to_string(ccs, '|') AS ccs_concepts FROM p")
def latex_parse(spark, d):
    """Fields of a LaTeX source."""
    r = latex.parse(synth.manuscripts(spark, d))
    bar = lambda c: F.array_join(c, "|").alias(c)
    return r.select("doc_id", "title", bar("authors"), "abstract", bar("keywords"), "acknowledgments", bar("ccs_concepts"))


@query("WITH {m}, " + _PARSE + "SELECT doc_id, ord::BIGINT AS ord, title, content FROM s")
def latex_sections(spark, d):
    """Sections up to the next one, cut at the bibliography."""
    m = synth.manuscripts(spark, d)
    return m.select("doc_id", F.explode(latex.sections(F.col("latex"))).alias("s")).select("doc_id", F.col("s.ord").cast("long").alias("ord"), "s.title", "s.content")


@query(r"""WITH {m} SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(latex, '(?i)\\documentclass(?:\[[^\]]*\])?\{acmart\}') THEN 'class of acm'
       WHEN regexp_matches(latex, '(?i)\\begin\{CCSXML\}|\\ccsdesc|\\acmConference|\\acmDOI|\\setcopyright|\\acmISBN|\\acmPrice|\\received') THEN 'commands of acm' END,
  CASE WHEN NOT regexp_matches(latex, '(?i)\\documentclass(?:\[[^\]]*\])?\{IEEEtran\}') THEN 'no class of ieee' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM m""")
def format_guard(spark, d):
    return synth.manuscripts(spark, d).select("doc_id", F.array_join(latex.format_guard(F.col("latex"), "ieee"), "; ").alias("warnings"))


@query(r"""WITH {m}, pre AS (SELECT doc_id, string_split(latex, '\begin{document}')[1] AS pre FROM m)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_extract(pre, '\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}', 1), ','), lambda x: trim(x)),
   lambda x: x NOT IN ('graphicx','amsmath','amssymb','float','placeins','IEEEtran','acmart') AND x <> ''), '|') AS packages,
   regexp_extract(pre, '(\\usetikzlibrary\{[^}]+\})', 1) AS libraries FROM pre""")
def source_packages(spark, d):
    pre = latex.preamble(F.col("latex"))
    return synth.manuscripts(spark, d).select("doc_id", F.array_join(latex.source_packages(pre), "|").alias("packages"), F.array_join(latex.tikz_libraries(pre), "|").alias("libraries"))


@query(r"""WITH {m}, k AS (SELECT DISTINCT doc_id, trim(unnest(string_split(g, ','))) AS key FROM (SELECT doc_id, unnest(regexp_extract_all(latex, '\\cite\{([^}]+)\}', 1)) AS g FROM m)),
o AS (SELECT doc_id, string_agg(CASE WHEN NOT regexp_matches(key, '^ref[0-8]$') THEN key END, '|' ORDER BY key) AS unresolved, count(*) AS n, count_if(NOT regexp_matches(key, '^ref[0-8]$')) AS bad FROM k GROUP BY 1)
SELECT doc_id, CASE WHEN bad = n THEN 'warn' ELSE 'pass' END AS status, coalesce(unresolved, '') AS unresolved FROM o""")
def cite_anti(spark, d):
    """Citation keys without a reference, and the status that follows."""
    known = F.transform(_refs(), lambda r: r["key"])
    m = synth.manuscripts(spark, d).select("doc_id", latex.citation_status(F.col("latex"), known).alias("c"))
    return m.select("doc_id", "c.status", F.array_join("c.unresolved", "|").alias("unresolved"))


@query(r"""WITH {m}, r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(latex, '\\ref\{([^}]+)\}', 1)) AS target FROM m),
l AS (SELECT doc_id, unnest(regexp_extract_all(latex, '\\label\{([^}]+)\}', 1)) AS target FROM m)
SELECT doc_id, target FROM r ANTI JOIN l USING (doc_id, target)""")
def ref_label_anti(spark, d):
    """Reference targets without a label."""
    return synth.manuscripts(spark, d).select("doc_id", F.explode(latex.unresolved_refs(F.col("latex"), "")).alias("target"))


@query("WITH {m}, " + _PARSE + "SELECT doc_id, CASE WHEN count_if(lower(title) = 'conclusion') = 0 THEN 'Conclusion' ELSE '' END AS missing FROM s GROUP BY doc_id")
def missing_sections(spark, d):
    m = synth.manuscripts(spark, d)
    return m.select("doc_id", F.array_join(latex.missing_sections(latex.sections(F.col("latex")), K.EXPECTED_SECTIONS), "|").alias("missing"))


_COLL = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query("WITH {m}, " + _PARSE + f"SELECT doc_id, {_COLL('title')} AS title, array_to_string(list_transform(authors, lambda x: {_COLL('x')}), '|') AS authors, "
       "array_to_string(list_filter([CASE WHEN len(ccs) > 0 THEN 'CCS concepts without CCSXML' END, CASE WHEN len(authors) = 0 THEN 'no authors' END, CASE WHEN abstract = '' THEN 'no abstract' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM p")
def normalized(spark, d):
    r = convert.normalize(_records(spark, d))
    return r.select("doc_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join(convert.normalization_warnings("acm"), "; ").alias("warnings"))


@query("WITH {m}, " + _PARSE + """SELECT doc_id, array_to_string(list_filter([CASE WHEN abstract = '' THEN 'abstract' END, CASE WHEN len(authors) = 0 THEN 'authors' END, CASE WHEN len(ccs) > 0 THEN 'ccsxml' END,
 CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 <> 0 THEN 'affiliations' END, 'conference', CASE WHEN len(keywords) = 0 THEN 'keywords' END], lambda x: x IS NOT NULL), '; ') AS items FROM p""")
def unresolved_items(spark, d):
    return _records(spark, d).select("doc_id", F.array_join(convert.unresolved_items("acm"), "; ").alias("items"))


_ESC = lambda x: rf"regexp_replace({x}, '([&%$#_])', '\\\1', 'g')"
_BODY = """b AS (SELECT doc_id, string_agg('\\section{' || CASE WHEN lower(t) IN ('conclusion', 'conclusions') THEN 'Conclusion' ELSE t END || '}' || chr(10) || content || chr(10) || '\\FloatBarrier' || chr(10), chr(10) ORDER BY ord) AS body
  FROM (SELECT *, """ + _COLL("title") + """ AS t FROM s) GROUP BY doc_id)"""


@query("WITH {m}, " + _PARSE + ", " + _BODY + r"""
SELECT doc_id, md5('\documentclass[conference]{IEEEtran}' || chr(10) || '\usepackage{graphicx}' || chr(10) || '\usepackage{float}' || chr(10) || '\usepackage{amsmath}' || chr(10) || '\begin{document}' || chr(10)
 || '\title{' || """ + _COLL("title") + r""" || '}' || chr(10) || '\author{' || CASE WHEN len(authors) = 0 THEN 'Anonymous' ELSE array_to_string(list_filter([array_to_string(list_transform(authors, lambda x: """ + _COLL("x") + r"""), ' \and '),
   CASE WHEN doc_id % 3 = 0 THEN 'Uni A \& B \and Lab C \and Inst D \and Inst E' END, CASE WHEN doc_id % 2 = 0 THEN 'a\_' || doc_id || '@x.org' END], lambda x: x IS NOT NULL), ' \\ ') END || '}' || chr(10) || '\maketitle' || chr(10)
 || '\begin{abstract}' || chr(10) || abstract || chr(10) || '\end{abstract}' || chr(10)
 || CASE WHEN len(keywords) = 0 THEN '' ELSE '\begin{IEEEkeywords}' || chr(10) || array_to_string(keywords, ', ') || chr(10) || '\end{IEEEkeywords}' END || chr(10) || chr(10)
 || body || CASE WHEN acknowledgments = '' THEN '' ELSE chr(10) || '\section*{Acknowledgments}' || chr(10) || acknowledgments || chr(10) END || chr(10)
 || '\bibliographystyle{IEEEtran}' || chr(10) || '\bibliography{references}' || chr(10) || '\end{document}' || chr(10)) AS main_md5
FROM p JOIN b USING (doc_id)""")
def render_ieee(spark, d):
    """The rendered main file for IEEE, by digest."""
    return convert.normalize(_records(spark, d)).select("doc_id", F.md5(convert.render_main("ieee").cast("binary")).alias("main_md5"))


@query()
def render_acm(spark, d):
    """The rendered main file for ACM, and its bibliography."""
    r = convert.normalize(_records(spark, d))
    return r.select("doc_id", convert.render_main("acm").alias("main"), convert.render_bib(F.col("references")).alias("bib"))


@query("WITH {m}, " + _PARSE + """, c AS (SELECT doc_id, count_if(lower(title) = 'conclusion') AS n FROM s GROUP BY 1),
k AS (SELECT DISTINCT doc_id, trim(unnest(string_split(g, ','))) AS key FROM (SELECT doc_id, unnest(regexp_extract_all(latex, '\\\\cite\\{([^}]+)\\}', 1)) AS g FROM m)),
o AS (SELECT doc_id, count_if(NOT regexp_matches(key, '^ref[0-8]$')) = count(*) AS bad FROM k GROUP BY 1)
SELECT doc_id, 'pass' AS template, CASE WHEN bad THEN 'warn' ELSE 'pass' END AS citation,
  array_to_string(list_filter([CASE WHEN n = 0 THEN 'expected sections missing' END, CASE WHEN bad THEN 'citations' END,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'pattern 0' END, CASE WHEN doc_id % 2 = 0 THEN 'pattern 1' END, CASE WHEN doc_id % 2 = 0 THEN 'class' END,
  CASE WHEN doc_id % 4 <> doc_id % 3 THEN 'figure refs' END, 'table refs'], lambda x: x IS NOT NULL), '; ') AS warnings
FROM c JOIN o USING (doc_id)""")
def validated(spark, d):
    """Layered validation of a source against the ACM target."""
    m = synth.manuscripts(spark, d)
    v = convert.validate(F.col("latex"), latex.sections(F.col("latex")), F.transform(_refs(), lambda r: r["key"]), "acm")
    return m.select("doc_id", v.alias("v")).select("doc_id", "v.template", "v.citation", F.array_join("v.warnings", "; ").alias("warnings"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ieee->acm' ELSE 'acm->ieee' END AS direction, CASE WHEN doc_id % 4 = 3 OR doc_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status FROM documents")
def route_status(spark, d):
    even = F.col("doc_id") % 2 == 0
    template = F.when(F.col("doc_id") % 4 == 3, "fail").when(F.col("doc_id") % 4 == 2, "warn").otherwise("pass")
    compiled = F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("success")
    return _docs(spark, d).select(
        "doc_id",
        convert.route(F.when(even, "IEEE").otherwise("acm"), F.when(even, "acm").otherwise("Ieee")).alias("direction"),
        convert.final_status(template, compiled, F.lit(True)).alias("status"),
    )


@query(r"""SELECT DISTINCT doc_id, line FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents)
WHERE length(line) > 25 GROUP BY 1, 2 HAVING count(*) >= 2)""")
def repeated_lines(spark, d):
    """Repeated long lines of each document."""
    return _docs(spark, d).select("doc_id", F.explode(pdf_text.repeated_lines(F.col("text"))).alias("line"))


@query("""WITH l AS (SELECT doc_id, lower(substr(text, 1, 20000)) AS t FROM documents),
c AS (SELECT doc_id, list_sum(list_transform([""" + ",".join(f"'{c}'" for c in K.THESIS_CUES) + """], lambda c: contains(t, c)::INT))::INT AS thesis,
 list_sum(list_transform([""" + ",".join(f"'{c}'" for c in K.PAPER_CUES) + """], lambda c: contains(t, c)::INT))::INT AS paper,
 contains(t, 'ieee')::INT + contains(t, 'index terms')::INT AS ieee, contains(t, 'acm')::INT + contains(t, 'acm reference format')::INT AS acm FROM l)
SELECT doc_id, CASE WHEN thesis >= 3 THEN 'thesis_dissertation' WHEN ieee >= 1 THEN 'ieee_paper' WHEN acm >= 1 THEN 'acm_paper' ELSE 'generic_academic_pdf' END AS kind, thesis, paper, ieee, acm FROM c""")
def document_type(spark, d):
    return _docs(spark, d).select("doc_id", pdf_text.document_type(F.col("text")).alias("t")).select("doc_id", "t.*")


_HEADER = "(?i)" + "|".join(K.HEADER_FOOTER)


@query(rf"""WITH {{m}}, l AS (SELECT doc_id, u.i AS i, {_s("u.x")} AS x FROM (SELECT doc_id, unnest(list_transform(string_split(pdf, chr(10)), lambda x, i: {{'x': x, 'i': i}})) AS u FROM m)),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS k,
  coalesce(min(CASE WHEN regexp_matches(x, '{K.FRONTMATTER_BOUNDARY}') THEN i END) OVER (PARTITION BY doc_id), 1000000) AS b FROM l),
k AS (SELECT doc_id, i, x FROM w WHERE x = '' OR CASE WHEN n >= 2 AND length(x) > 30 THEN i < b AND k = 1
  ELSE NOT regexp_matches(x, '{_HEADER}') AND NOT (length(x) >= 10 AND regexp_matches(x, '{K.FOOTER_LINES}')) END)
SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS kept FROM k GROUP BY doc_id""")
def kept_lines(spark, d):
    """Lines that survive the page cleaning."""
    return synth.manuscripts(spark, d).select("doc_id", F.array_join(pdf_text.keep_lines(F.col("pdf")), "\n").alias("kept"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '([A-Za-z0-9_])-\s+([a-z])', '\1\2', 'g')) AS spaced FROM documents""")
def spacing(spark, d):
    """Spacing and hyphenation passes, by digest."""
    from .functions.text import normalize_spacing, repair_hyphenation

    return _docs(spark, d).select("doc_id", F.md5(repair_hyphenation(normalize_spacing(text("text"))).cast("binary")).alias("spaced"))


@query()
def cleaned_text(spark, d):
    """The whole cleaning of an extracted text."""
    return synth.manuscripts(spark, d).select("doc_id", pdf_text.clean(F.col("pdf")).alias("cleaned"), pdf_text.clean(F.col("pdf"), "aggressive").alias("aggressive"))


@query(rf"""WITH {{m}} SELECT doc_id, {_COLL(r"regexp_extract(pdf, '(?is)Abstract[\s—-]+(.*?)(?:Index Terms|Keywords|(?:^|\n)(?:I\.\s*INTRODUCTION|INTRODUCTION)\b)', 1)")} AS abstract, 'alpha|beta|gamma' AS keywords,
 CASE WHEN contains(substr(pdf, 1, 5000), 'IEEE') THEN 'ieee' ELSE 'unknown' END AS format FROM m""")
def pdf_frontmatter(spark, d):
    c = F.col("pdf")
    return synth.manuscripts(spark, d).select("doc_id", pdf_text.abstract(c).alias("abstract"), F.array_join(pdf_text.keywords(c), "|").alias("keywords"), pdf_text.guess_format(c).alias("format"))


@query()
def pdf_sections(spark, d):
    """Sections of an extracted text."""
    m = synth.manuscripts(spark, d)
    return m.select("doc_id", F.posexplode(pdf_text.sections(F.col("pdf"))).alias("ord", "s")).select("doc_id", "ord", "s.title", "s.content")


@query(rf"""WITH {{m}}, l AS (SELECT doc_id, u.i - 1 AS pos, {_s("u.x")} AS x FROM (SELECT doc_id, unnest(list_transform(string_split(pdf, chr(10)), lambda x, i: {{'x': x, 'i': i}})) AS u FROM m))
SELECT doc_id, pos::INT AS pos, x AS title FROM l WHERE regexp_matches(x, '{K.ROMAN_HEADING}') OR regexp_matches(x, '^\d+(?:\.\d+)?\.?\s+[A-Z][A-Za-z][A-Za-z0-9''&/\-]*(?:\s+[A-Z][A-Za-z0-9''&/\-]*){{0,6}}$')""")
def numbered_headings(spark, d):
    """Numbered headings of an extracted text."""
    m = synth.manuscripts(spark, d)
    lines = F.transform(lines_of(F.col("pdf")), lambda x: strip(x))
    return m.select("doc_id", F.posexplode(lines).alias("pos", "title")).filter(F.col("title").rlike(K.ROMAN_HEADING) | F.col("title").rlike(K.ARABIC_HEADING))


@query(rf"""SELECT doc_id, 'Body' AS title, {_COLL("replace(replace(array_to_string(CASE WHEN len(c) > 3 THEN c[4:] ELSE c END, ' '), chr(65533), '-'), chr(8217), '''')")} AS content
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\n+'), lambda x: {_s('x')}), lambda x: x <> '') AS c FROM documents) WHERE len(c) > 0""")
def fallback_sections(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(pdf_text.fallback_section(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query(rf"""SELECT doc_id, array_to_string(list(e ORDER BY k), '|') AS emails FROM (SELECT doc_id, e, min(i) AS k FROM
 (SELECT doc_id, u.e AS e, u.i AS i FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{K.EMAIL}'), lambda e, i: {{'e': e, 'i': i}})) AS u FROM documents)) GROUP BY 1, 2) GROUP BY 1""")
def emails(spark, d):
    """Distinct addresses of a text, in order."""
    return _docs(spark, d).select("doc_id", F.array_join(pdf_text.emails(F.col("text")), "|").alias("emails")).filter("emails <> ''")


@query("SELECT doc_id, md5(" + _ESC("coalesce(text, '')").replace("'([&%$#_])'", "'([&%$#_])'") + ") AS escaped FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[~^\\\\]')")
def escaped_latex(spark, d):
    """Escaped texts, by digest.  The SQL lacks look-behind and holds only for tables without
    a tilde, caret or backslash, as the given ones are; others are tested by brute force."""
    return _docs(spark, d).select("doc_id", F.md5(escape_latex(text("text")).cast("binary")).alias("escaped"))


@query(r"""SELECT doc_id, count_if(n >= 10 AND low >= greatest(4, n // 2)) ::BIGINT AS paragraphs, count_if(n >= 6 AND low >= greatest(3, n // 3))::BIGINT AS body_lines,
 count_if(regexp_matches(x, '\(\s*-?\d') OR (len(regexp_extract_all(x, '\d')) >= 4 AND n <= 12))::BIGINT AS data_lines FROM (
 SELECT doc_id, x, len(w) AS n, len(list_filter(w, lambda y: regexp_matches(y, '\p{Ll}'))) AS low FROM (
 SELECT doc_id, x, list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '') AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents))) GROUP BY doc_id""")
def line_kinds(spark, d):
    """How many lines of a text are prose, body or data lines."""
    n = lambda f: F.size(F.filter("l", f)).cast("long")
    return _docs(spark, d).select("doc_id", lines_of(F.col("text")).alias("l")).select(
        "doc_id", n(P.is_body_paragraph).alias("paragraphs"), n(P.is_body_line).alias("body_lines"), n(P.is_table_data).alias("data_lines")
    )


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\$([^$]+)\$', 1)[:50], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '|') AS equations FROM documents WHERE regexp_matches(text, '\$[^$]+\$')""")
def inline_equations(spark, d):
    return _docs(spark, d).filter(F.col("text").rlike(r"\$[^$]+\$")).select("doc_id", F.array_join(structure.inline_equations(F.col("text")), "|").alias("equations"))


@query(r"""SELECT doc_id, u.i - 1 AS ord, u.x AS paragraph FROM (SELECT doc_id, unnest(list_transform(c, lambda x, i: {'x': regexp_replace(x, '\s+', ' ', 'g'), 'i': i})) AS u FROM (
 SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
  lambda x: length(x) BETWEEN 51 AND 2999 AND NOT regexp_matches(x, '(?i)^([0-9]+\.|[•\-*]|\$|Table|Figure|Algorithm)'))[:100] AS c FROM documents))""")
def text_paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(structure.paragraphs(F.col("text"))).alias("ord", "paragraph")).withColumn("ord", F.col("ord").cast("long"))


@query(r"""WITH l AS (SELECT doc_id, u.i AS i, u.x AS x, list_filter(list_transform(regexp_split_to_array(regexp_replace(u.x, '^\s+|\s+$', '', 'g'), '\s{2,}|\|'), lambda y: trim(y)), lambda y: y <> '') AS c
   FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'x': x, 'i': i})) AS u FROM documents)),
r AS (SELECT *, (contains(x, '|') OR regexp_matches(x, '^[\s\w]+\s{2,}[\w\s]+')) AND length(trim(x)) > 10 AND len(c) > 1 AS row, length(trim(x)) < 3 AS gap FROM l),
g AS (SELECT *, sum(CASE WHEN gap AND NOT row THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r)
SELECT doc_id, g0 - 1 AS ord, n AS n_rows, rows FROM (SELECT doc_id, g, count(*) AS n, string_agg(array_to_string(c, chr(9)), chr(10) ORDER BY i) AS rows, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS g0
 FROM g WHERE row GROUP BY doc_id, g HAVING count(*) >= 2) WHERE g0 <= 20""")
def table_runs(spark, d):
    """Runs of table rows among the lines of a text."""
    return (
        _docs(spark, d)
        .select("doc_id", F.posexplode(structure.tables(F.col("text"))).alias("ord", "t"))
        .select("doc_id", F.col("ord").cast("long").alias("ord"), F.size("t.items").cast("long").alias("n_rows"), F.array_join("t.items", "\n").alias("rows"))
    )


@query()
def list_runs(spark, d):
    """Bullet and numbered lists of a text."""
    return _docs(spark, d).select("doc_id", F.posexplode(structure.lists(F.col("text"))).alias("ord", "l")).select("doc_id", "ord", "l.kind", F.array_join("l.items", "\n").alias("items"))


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10))[:20], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 11 AND 199 AND NOT regexp_matches(x, '(?i)^(page|abstract|introduction|figure|table)'))[1] AS title,
 array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(substr(coalesce(text, ''), 1, 2000), '(?i)(?:keywords?|topics?)[\s:]*([^\n]+)', 1), '[,;]\s*'), lambda x: lower(trim(x))), lambda x: length(x) BETWEEN 3 AND 49)[:10], '|') AS keywords FROM documents""")
def structure_summary(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", structure.title(c).alias("title"), F.array_join(structure.keywords(c), "|").alias("keywords"))


@query()
def structure_sections(spark, d):
    """Generic headings with their levels."""
    return _docs(spark, d).select("doc_id", F.posexplode(structure.sections(F.col("text"))).alias("ord", "s")).select("doc_id", "ord", "s.*")


@query("WITH {m}, " + _PARSE + """, n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1)
SELECT doc_id, round(0.2 + CASE WHEN length(abstract) > 200 THEN 0.2 ELSE 0 END + CASE WHEN k >= 4 THEN 0.2 ELSE 0 END + CASE WHEN len(keywords) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 0.1 ELSE 0 END + 0.1
 + CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 0.1 ELSE 0 END, 2)::DOUBLE AS confidence, k AS n_sections, len(authors)::BIGINT AS n_authors, abstract <> '' AS abstract_present FROM p JOIN n USING (doc_id)""")
def ingest_confidence(spark, d):
    """Confidence and counts of a record."""
    r = _records(spark, d)
    return r.select("doc_id", convert.confidence().alias("confidence"), *[c for c in convert.summary()]).select("doc_id", "confidence", "n_sections", "n_authors", "abstract_present")


@query()
def caption_candidates(spark, d):
    """The first four figure and three table captions of an extracted text."""
    m = synth.manuscripts(spark, d)
    return m.select("doc_id", F.explode(pdf_text.caption_candidates(F.col("pdf"))).alias("c")).select("doc_id", "c.*")


@query(r"""WITH {m}, t AS (SELECT doc_id, regexp_extract(pdf, '(?s)\nREFERENCES\n(.*)$', 1) AS tail FROM m),
r AS (SELECT doc_id, 'ref' || regexp_extract(x, '^\[(\d+)\]', 1) AS key, trim(regexp_replace(regexp_replace(x, '^\[\d+\]', ''), '\s+', ' ', 'g')) AS raw FROM (SELECT doc_id, unnest(regexp_extract_all(tail, '\[\d+\][^\[]*')) AS x FROM t))
SELECT doc_id, key, raw, CASE WHEN regexp_matches(raw, '(?i)proceedings|conference|symposium|workshop') THEN 'inproceedings' WHEN regexp_matches(raw, '(?i)journal|transactions|vol\.') THEN 'article' ELSE 'misc' END AS kind,
 regexp_extract(raw, '\b(19\d\d|20\d\d)\b', 1) AS year, regexp_extract(raw, 'vol\. (\d+)', 1) AS volume, regexp_extract(raw, 'no\. (\d+)', 1) AS number, regexp_extract(raw, 'pp\. (\d+-\d+)', 1) AS pages FROM r""")
def reference_fields(spark, d):
    """Entries of a bibliography and their fields."""
    tail = F.regexp_extract("pdf", r"(?s)\nREFERENCES\n(.*)$", 1)
    refs = synth.manuscripts(spark, d).select("doc_id", F.explode(pdf_text.reference_entries(tail)).alias("r"))
    f = pdf_text.citation_fields(F.col("r.raw"))
    return refs.select("doc_id", "r.key", "r.raw", f.alias("f")).select("doc_id", "key", "raw", "f.kind", "f.year", "f.volume", "f.number", "f.pages")


@query()
def pdf_records(spark, d):
    """Whole records of extracted texts, with citations of known references."""
    r = pdf_text.parse(synth.manuscripts(spark, d))
    return r.select("doc_id", "title", "abstract", F.to_json("sections").alias("sections"), F.size("references").alias("n_references"), "kind")


@query(r"""SELECT l_orderkey AS doc_id, (l_linenumber % 3)::VARCHAR AS key, arg_max(l_partkey, (l_linenumber, l_partkey))::VARCHAR AS raw FROM lineitem GROUP BY 1, 2""")
def last_by_key(spark, d):
    """One entry for each key of an order's lines: the last value."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey")
    each = F.struct("l_linenumber", "l_partkey", (F.col("l_linenumber") % 3).cast("string").alias("key"), F.col("l_partkey").cast("string").alias("raw"))
    lists = li.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("x")).select("doc_id", F.transform("x", lambda r: F.struct(r["key"].alias("key"), r["raw"].alias("raw"))).alias("x"))
    return lists.select("doc_id", F.explode(pdf_text.last_by_key(F.col("x"))).alias("r")).select("doc_id", "r.*")


_VIS = """t AS (SELECT doc_id, 'fig:' || doc_id % 3 AS label, split_part(coalesce(text, ''), chr(10), 1) AS caption, CASE WHEN doc_id % 2 = 0 THEN 'a.png' ELSE '' END AS path FROM documents),
p AS (SELECT doc_id, 'fig:' || doc_id % 2 AS label, split_part(coalesce(text, ''), chr(10), -1) AS caption, 'p.png' AS path FROM documents)"""


@query("WITH " + _VIS + """ SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(t.label, p.label) AS label,
 CASE WHEN t.caption IS NULL OR (p.caption <> '' AND (length(p.caption) < length(t.caption) OR starts_with(lower(t.caption), 'overview validation'))) THEN p.caption ELSE t.caption END AS caption,
 coalesce(nullif(t.path, ''), p.path, '') AS path, CASE WHEN t.caption IS NOT NULL AND p.caption IS NOT NULL THEN 'H' ELSE 'tbp' END AS placement
FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.label = p.label""")
def visual_full_outer(spark, d):
    """Captions from text (a document's first line) and pages (its last), merged by label."""
    docs = _docs(spark, d)
    t = docs.selectExpr("doc_id", "concat('fig:', doc_id % 3) AS label", "split_part(coalesce(text, ''), chr(10), 1) AS caption", "CASE WHEN doc_id % 2 = 0 THEN 'a.png' ELSE '' END AS path")
    p = docs.selectExpr("doc_id", "concat('fig:', doc_id % 2) AS label", "split_part(coalesce(text, ''), chr(10), -1) AS caption", "'p.png' AS path")
    return layout.merge_visuals(t, p)


@query("""WITH f AS (SELECT doc_id, unnest(range(0, doc_id % 4)) AS ord FROM documents), i AS (SELECT doc_id, unnest(range(0, doc_id % 5)) AS ord FROM documents)
SELECT coalesce(f.doc_id, i.doc_id) AS doc_id, coalesce(f.ord, i.ord) AS ord, CASE WHEN f.ord IS NULL THEN 'fig:extracted' || (i.ord + 1) ELSE 'fig:' || f.ord END AS label, CASE WHEN i.ord IS NULL THEN '' ELSE 'img' || i.ord END AS path
FROM f FULL JOIN i ON f.doc_id = i.doc_id AND f.ord = i.ord""")
def asset_zip(spark, d):
    """Figures and images paired by position."""
    docs = _docs(spark, d)
    count = lambda n: docs.filter(F.col("doc_id") % n > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % n - 1)).alias("ord"))
    return layout.attach_assets(count(4).withColumn("label", F.concat(F.lit("fig:"), F.col("ord"))), count(5).withColumn("name", F.concat(F.lit("img"), F.col("ord"))))


@query("WITH {m}, " + _PARSE + """, a AS (SELECT doc_id, u.k::VARCHAR AS label, u.s AS snippet FROM (SELECT doc_id, unnest([{'k': 1, 's': substr(text, 120, 60)}, {'k': 2, 's': substr(text, 900, 40)}, {'k': 3, 's': 'not there at all'}]) AS u FROM documents)),
h AS (SELECT a.doc_id, label, arg_min(title, ord) AS section FROM a JOIN s ON a.doc_id = s.doc_id AND (contains(content, snippet) OR contains(content, array_to_string(string_split(snippet, ' ')[:12], ' '))) GROUP BY 1, 2)
SELECT a.doc_id, a.label, h.section FROM a LEFT JOIN h USING (doc_id, label)""")
def section_theta(spark, d):
    """The section that holds an artifact's snippet."""
    s = synth.manuscripts(spark, d).select("doc_id", F.explode(latex.sections(F.col("latex"))).alias("s")).select("doc_id", "s.*")
    a = _docs(spark, d).selectExpr("doc_id", "stack(3, '1', substr(text, 120, 60), '2', substr(text, 900, 40), '3', 'not there at all') AS (label, snippet)")
    return layout.locate(a, s).select("doc_id", "label", "section")


@query("WITH {m}, l AS ({lines}) " + r"""SELECT doc_id, page, ord, coalesce(last_value(CASE WHEN regexp_matches(text, '^[IVX]+\.\s+[A-Z][A-Z\s\-]+$')
  THEN (CASE text WHEN 'I. INTRODUCTION' THEN 'Introduction' WHEN 'II. METHOD' THEN 'Method' WHEN 'III. CONCLUSION' THEN 'Conclusion' END) END IGNORE NULLS)
  OVER (PARTITION BY doc_id, page ORDER BY ord ROWS UNBOUNDED PRECEDING), '') AS section FROM l""")
def heading_asof(spark, d):
    """The heading that each line of a page stands under."""
    return layout.section_headings(synth.page_lines(spark, d)).select("doc_id", "page", "ord", "section")


_BUCKET = "CASE WHEN (x0 + x1) / 2 < 600 * 0.43::DOUBLE THEN 'left' WHEN (x0 + x1) / 2 > 600 * 0.57::DOUBLE THEN 'right' ELSE 'center' END"


@query("WITH {m}, l AS ({lines}), b AS (SELECT *, " + _BUCKET + " AS bucket FROM l) " + r"""
SELECT doc_id, page, bucket, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_lines FROM b GROUP BY 1, 2, 3""")
def column_envelopes(spark, d):
    """The envelope of each column of a page."""
    b = synth.page_lines(spark, d).withColumn("bucket", P.column_bucket(F.col("x0"), F.col("x1"), F.lit(600.0)))
    return b.groupBy("doc_id", "page", "bucket").agg(*layout.envelope(), F.count(F.lit(1)).alias("n_lines"))


@query("WITH {m}, l AS ({lines}), b AS (SELECT *, " + _BUCKET + r""" AS bucket, text <> '' AND NOT regexp_matches(text, '(?i)^(?:TABLE\s+[IVXLC0-9]+|Fig\.\s*\d+|REFERENCES$)') AS ok FROM l),
k AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY doc_id, page, bucket ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b)
SELECT a.doc_id, a.page, a.ord, coalesce(string_agg(c.text, ' ' ORDER BY c.k), '') AS anchor FROM k a LEFT JOIN k c ON a.doc_id = c.doc_id AND a.page = c.page AND a.bucket = c.bucket AND c.ok AND c.k < a.k AND c.k >= a.k - 4
GROUP BY 1, 2, 3""".replace("string_agg(c.text, ' ' ORDER BY c.k)", _COLL("replace(replace(string_agg(c.text, ' ' ORDER BY c.k), chr(65533), '-'), chr(8217), '''')")))
def anchor_last4(spark, d):
    """The last four lines before a line, in its column."""
    return layout.anchors(synth.page_lines(spark, d), 600.0).select("doc_id", "page", "ord", "anchor")


@query("WITH {m}, l AS (SELECT * FROM ({lines}) WHERE text <> '' AND length(text) % 4 <> 0), b AS (SELECT *, " + _BUCKET + """ AS bucket FROM l),
g AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w > 42 OR lag(y1) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY doc_id, page, bucket ORDER BY ord)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, bucket ORDER BY ord) AS session FROM g)
SELECT doc_id, page, bucket, session::BIGINT AS session, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_lines FROM n GROUP BY 1, 2, 3, 4""")
def gap_sessions(spark, d):
    """Runs of lines without a vertical gap."""
    lines = synth.page_lines(spark, d).filter((F.col("text") != "") & (F.length("text") % 4 != 0))
    return layout.gap_sessions(lines, 600.0)


@query()
def equation_regions(spark, d):
    """Grown equation regions of pages (stateful)."""
    math = F.when(F.col("ord") % 5 == 0, F.lit("y = a * x + (3)")).when(F.col("ord") % 5 == 1, F.lit("(2)")).otherwise(F.col("text"))
    return layout.equation_regions(synth.page_lines(spark, d).withColumn("text", math), 600.0)


@query()
def figure_regions(spark, d):
    """Figure bands above captions."""
    lines = synth.page_lines(spark, d)
    boxes = lines.filter("ord % 7 = 0").select("doc_id", "page", "x0", "y0", "x1", "y1")
    return layout.figure_regions(lines, boxes, 600.0)


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_partkey % 100 AS lo, l_partkey % 100 + l_quantity::BIGINT AS hi FROM lineitem),
r AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo, hi) AS island FROM r)
SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY doc_id, island""")
def span_merge(spark, d):
    """Overlapping spans merged."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return layout.merge_spans(li.selectExpr("l_orderkey AS doc_id", "l_partkey % 100 AS lo", "l_partkey % 100 + CAST(l_quantity AS BIGINT) AS hi"))


@query("""WITH i AS (SELECT l_orderkey AS doc_id, l_partkey % 5 AS xref, l_linenumber AS page, l_suppkey AS ord, l_quantity * 8 AS width, l_quantity * 6 AS height FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, xref ORDER BY page, ord, width) AS rn FROM i),
k AS (SELECT * FROM r WHERE rn = 1 AND width >= 120 AND height >= 120 AND width * height >= 24000)
SELECT doc_id, xref, 'figure_p' || page || '_' || row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, xref) AS name FROM k""")
def xref_dedup(spark, d):
    """Distinct large images, named."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    i = li.selectExpr("l_orderkey AS doc_id", "l_partkey % 5 AS xref", "l_linenumber AS page", "l_suppkey AS ord", "l_quantity * 8 AS width", "l_quantity * 6 AS height")
    return layout.distinct_images(i).select("doc_id", "xref", "name")


_FILES = """f AS (SELECT 'p' || (doc_id // 5) AS project, CASE doc_id % 5 WHEN 0 THEN 'a.tex' WHEN 1 THEN 'sub/main.tex' WHEN 2 THEN 'b.tex' WHEN 3 THEN 'refs' || (doc_id % 2) || '.bib' ELSE 'figs/x.png' END AS rel_path,
  CASE WHEN doc_id % 3 = 0 THEN chr(92) || 'begin{document}' ELSE 'plain' END AS content, length(text)::BIGINT AS size_bytes FROM documents)"""


def _files(spark, d) -> DataFrame:
    return _docs(spark, d).selectExpr(
        "concat('p', doc_id DIV 5) AS project",
        "CASE doc_id % 5 WHEN 0 THEN 'a.tex' WHEN 1 THEN 'sub/main.tex' WHEN 2 THEN 'b.tex' WHEN 3 THEN concat('refs', doc_id % 2, '.bib') ELSE 'figs/x.png' END AS rel_path",
        "CASE WHEN doc_id % 3 = 0 THEN concat(chr(92), 'begin{document}') ELSE 'plain' END AS content",
        "CAST(length(text) AS BIGINT) AS size_bytes",
    )


@query("WITH " + _FILES + r""", r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY contains(rel_path, '/'), NOT contains(content, '\begin{document}'), rel_path) AS rn FROM f WHERE rel_path LIKE '%.tex')
SELECT project, rel_path FROM r WHERE rn = 1""")
def entry_files(spark, d):
    """The entry file of each project."""
    return projects.entry_files(_files(spark, d)).select("project", "rel_path")


@query("WITH " + _FILES + """, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY size_bytes DESC, rel_path) AS rn FROM f WHERE rel_path LIKE '%.bib') SELECT project, rel_path, size_bytes FROM r WHERE rn = 1""")
def bib_argmax(spark, d):
    return projects.largest_bib(_files(spark, d)).select("project", "rel_path", "size_bytes")


@query("WITH " + _FILES + """ SELECT DISTINCT project, 'figs/' AS folder FROM f WHERE rel_path LIKE '%.png' UNION SELECT DISTINCT project, './' FROM f""")
def graphics_roots(spark, d):
    return projects.image_folders(_files(spark, d))


@query("WITH " + _FILES + """ SELECT project, regexp_extract(rel_path, '([^/]+)$', 1) AS name, min(rel_path) AS rel_path FROM f GROUP BY 1, 2 HAVING count(*) = 1""")
def unique_basenames(spark, d):
    return projects.unique_basenames(_files(spark, d))


@query()
def spliced_projects(spark, d):
    """Projects with their includes spliced in."""
    files = _files(spark, d).filter("rel_path LIKE '%.tex'").withColumn("content", F.when(F.col("rel_path") == "a.tex", F.lit("A \\input{sub/main} \\include{b} \\input{none}")).otherwise(F.col("content")))
    return projects.inline_includes(files, projects.entry_files(files))


@query("WITH " + r"""r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'Anonymous' ELSE
 '\author{Ann}' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '\affiliation{\institution{Uni A \& B}}' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '\email{a\_1@x.org}' ELSE '' END
 || chr(10) || '\author{Bo}' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '\affiliation{\institution{Lab}}' || chr(10) || '\affiliation{\institution{Extra}}' ELSE '' END END AS block FROM documents) SELECT * FROM r""")
def author_zip(spark, d):
    """Authors, affiliations and emails paired by position."""
    none = F.array().cast("array<string>")
    pick = lambda cond, *v: F.when(cond, F.array(*[F.lit(x) for x in v])).otherwise(none)
    r = _docs(spark, d).select(
        "doc_id",
        pick(F.col("doc_id") % 17 != 0, "Ann", "Bo").alias("authors"),
        pick(F.col("doc_id") % 3 == 0, "Uni A & B", "Lab", "Extra").alias("affiliations"),
        pick(F.col("doc_id") % 2 == 0, "a_1@x.org").alias("emails"),
    )
    return r.select("doc_id", convert.render_authors("acm").alias("block"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'University of ' || c_custkey || '|Research Lab' ELSE 'University of ' || c_custkey END AS kept FROM customer""")
def affiliation_union(spark, d):
    """Distinct named institutions, as many as there are authors."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    items = F.array(F.concat(F.lit(" University  of "), F.col("c_custkey")), F.lit("x"), F.lit("Plain Street 5"), F.concat(F.lit("University of "), F.col("c_custkey")), F.lit("Research Lab"))
    authors = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return c.select(F.col("c_custkey").alias("doc_id"), F.array_join(pdf_text.paired(pdf_text.affiliations(items), authors), "|").alias("kept"))


_EVENTS = """e AS (SELECT user_id AS job_id, ts, event_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'success' END AS status, event_type AS stage, (event_id % 3 * 300)::INT AS timeout_seconds FROM events),
j AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(stage, (ts, event_id)) AS stage, arg_max(timeout_seconds, (ts, event_id)) AS timeout_seconds, max(ts) AS updated_at, coalesce(min(ts) FILTER (status = 'running'), min(ts)) AS started_at, count(*) AS n_events FROM e GROUP BY 1)"""


def _job_events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "user_id AS job_id", "ts", "event_id",
        "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'success' END AS status",
        "event_type AS stage", "CAST(event_id % 3 * 300 AS INT) AS timeout_seconds",
    )


@query("WITH " + _EVENTS + """, b AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM e),
 n AS (SELECT * FROM b WHERE before IS NULL OR stage IS DISTINCT FROM before)
 SELECT job_id, row_number() OVER w AS seq, stage, epoch_us(ts) AS entered_at, epoch_us(lead(ts) OVER w) AS left_at FROM n WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)""")
def job_timeline(spark, d):
    """The stages that each job went through."""
    found = jobs.timeline(_job_events(spark, d))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.withColumns({"seq": F.col("seq").cast("long"), "entered_at": micros("entered_at"), "left_at": micros("left_at")})


@query("WITH " + _EVENTS + """, x AS (SELECT user_id AS job_id, max(event_id % 3)::INT AS exit_code FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1)
 SELECT job_id, CASE WHEN status IN ('queued', 'running') AND exit_code IS NOT NULL THEN 'failed' ELSE status END AS status,
  CASE WHEN status IN ('queued', 'running') AND exit_code IS NOT NULL THEN 'worker_exit' END AS failure_kind FROM j LEFT JOIN x USING (job_id)""")
def job_worker_exit(spark, d):
    """Active jobs whose worker has ended; the last of the event types counts as a worker's end."""
    events = spark.read.parquet(f"{d}/events.parquet")
    last = events.agg(F.max("event_type").alias("event_type"))
    ended = events.join(F.broadcast(last), "event_type").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3).cast("int").alias("exit_code"))
    return jobs.worker_exit(jobs.latest(_job_events(spark, d)), ended).select("job_id", "status", "failure_kind")


@query("WITH " + _EVENTS + " SELECT job_id, status, stage, timeout_seconds, n_events FROM j")
def job_latest(spark, d):
    """The latest state of each job."""
    return jobs.latest(_job_events(spark, d)).select("job_id", "status", "stage", "timeout_seconds", "n_events")


@query("WITH " + _EVENTS + """ SELECT job_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN 'timeout' END AS failure_kind FROM (
 SELECT *, status = 'running' AND timeout_seconds > 0 AND epoch_us(TIMESTAMP '2024-06-01') - epoch_us(started_at) > timeout_seconds * 1000000 AS late FROM j)""")
def job_timeout(spark, d):
    """Running jobs past their timeout at a fixed time."""
    j = jobs.latest(_job_events(spark, d))
    return jobs.reconcile(j, F.lit("2024-06-01").cast("timestamp")).select("job_id", "status", "failure_kind")


@query("WITH " + _EVENTS + " SELECT count(*) AS live_workers FROM j WHERE status = 'running'")
def live_workers(spark, d):
    return jobs.live(jobs.latest(_job_events(spark, d)))


@query("WITH " + _EVENTS + """ SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' END AS failure_kind FROM j""")
def job_recovery(spark, d):
    """Jobs after a restart."""
    return jobs.interrupted(jobs.latest(_job_events(spark, d))).select("job_id", "status", "failure_kind")


@query("SELECT doc_id, array_to_string(l[greatest(1, len(l) - 24):], chr(10)) AS tail FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
def tail_lines(spark, d):
    """The last 25 lines of a log."""
    return _docs(spark, d).select("doc_id", let(lines_of(F.col("text")), lambda x: F.array_join(F.slice(x, F.greatest(F.lit(1), F.size(x) - 24), 25), "\n")).alias("tail"))


@query(r"""WITH {m}, b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN latex || latex ELSE replace(replace(latex, '\bibliographystyle{plain}' || chr(10), ''), '\bibliography{references}' || chr(10), '') END AS t FROM m)
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN string_split(t, '\end{document}')[1] || '\end{document}' || chr(10)
  ELSE replace(t, '\end{document}', '\bibliographystyle{ACM-Reference-Format}' || chr(10) || '\bibliography{references}' || chr(10) || '\end{document}') END) AS fixed FROM b""")
def repaired(spark, d):
    """Broken texts after the second round of repairs, by digest."""
    gone = lambda c, s: F.replace(c, F.lit(s), F.lit(""))
    broken = F.when(F.col("doc_id") % 2 == 0, F.concat("latex", "latex")).otherwise(gone(gone(F.col("latex"), "\\bibliographystyle{plain}\n"), "\\bibliography{references}\n"))
    return synth.manuscripts(spark, d).select("doc_id", F.md5(convert.repair(broken, 1).cast("binary")).alias("fixed"))


@query(rf"""SELECT doc_id, md5(regexp_replace({_s("replace(replace(coalesce(text, ''), 'γ', 'gamma'), '×', 'x')")}, '\s+', ' ', 'g')) AS folded FROM documents""")
def folded_text(spark, d):
    """Artifact text in plain letters, by digest."""
    return _docs(spark, d).select("doc_id", F.md5(normalise_artifact(text("text")).cast("binary")).alias("folded"))


@query(r"""SELECT doc_id, CASE WHEN n < 3 THEN '% reconstructed table unavailable' ELSE '\begin{tabular}{' || repeat('l', k) || '}' || chr(10) || array_to_string(list_transform(range(0, n // k), lambda r: array_to_string(c[r * k + 1:r * k + k], ' & ') || ' \\'), chr(10)) || chr(10) || '\end{tabular}' END AS latex
FROM (SELECT doc_id, list_transform(range(0, doc_id % 9), lambda i: 'c' || i) AS c, doc_id % 9 AS n, CASE WHEN doc_id % 9 >= 6 THEN 3 ELSE 2 END AS k FROM documents)""")
def table_latex(spark, d):
    """Flat cells as a table."""
    n = (F.col("doc_id") % 9).cast("int")
    cells = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("c"), i))).otherwise(F.array().cast("array<string>"))
    return _docs(spark, d).select("doc_id", layout.tabular(cells).alias("latex"))


@query(r"""WITH {m} SELECT doc_id, 'A Study of ' || coalesce(source, '') || ' Systems number ' || doc_id AS title, 'Ann Lee|Example University|ann' || doc_id || '@example.edu' AS profile FROM m JOIN documents USING (doc_id)""".replace("WITH {m} ", "").replace("FROM m JOIN documents USING (doc_id)", "FROM documents"))
def front_lines(spark, d):
    """Title lines, and one author block a document."""
    front = F.array(F.lit("Ann Lee"), F.lit("Department of Physics"), F.lit("Example University"), F.lit("Springfield, NC, USA"), F.concat(F.lit("ann"), F.col("doc_id"), F.lit("@example.edu")))
    # the department is noted apart from the institution
    profile = F.get(pdf_text.author_profiles(front), 0)
    return synth.manuscripts(spark, d).select("doc_id", pdf_text.title_of(F.col("pdf")).alias("title"), F.concat_ws("|", profile["name"], profile["institution"], profile["email"]).alias("profile"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS t, sha256(coalesce(text, '')) AS fingerprint FROM documents")
def fingerprints(spark, d):
    """SHA-256 of a source's text."""
    return _docs(spark, d).select("doc_id", F.md5(text("text").cast("binary")).alias("t"), F.sha2(text("text"), 256).alias("fingerprint"))


@query("""SELECT doc_id, n, snippet FROM (SELECT doc_id, x AS snippet, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, x) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) WHERE length(x) >= 24) WHERE n <= 4""")
def longest_snippets(spark, d):
    """The four longest distinct lines of a text, of 24 characters or more."""
    found = artifacts.longest_snippets(F.split(text("text"), "\n"))
    return _docs(spark, d).select("doc_id", F.posexplode(found).alias("n", "snippet")).withColumn("n", (F.col("n") + 1).cast("long"))


_THESIS = """t AS (SELECT doc_id, 'A dissertation submitted by Ann B. Lee entitled On ' || coalesce(source, '') || ' number ' || doc_id || chr(10) || 'and more be accepted' || chr(10)
 || 'ABSTRACT ' || chr(10) || 'Short words ' || doc_id || ' of  work iv and so on.' || chr(10) || 'DEDICATION to all' || chr(10) || 'CHAPTER 1 INTRODUCTION' || chr(10) || substr(coalesce(text, ''), 1, 400) || chr(10)
 || 'CHAPTER 2 METHODS' || chr(10) || substr(coalesce(text, ''), 401) || chr(10) || 'REFERENCES' || chr(10) || '[1] A. Author, Title of the first long entry, 2001. [2] short' AS thesis FROM documents)"""


def _theses(spark, d) -> DataFrame:
    import re

    expr = re.search(r"SELECT doc_id, (.*) AS thesis FROM", _THESIS, re.S).group(1)
    return _docs(spark, d).selectExpr("doc_id", f"({expr}) AS thesis")


@query("WITH " + _THESIS + r""" SELECT doc_id, trim(regexp_replace(regexp_extract(thesis, '(?is)entitled\s+(.*?)\s+(?:be\s+accepted|is\s+approved)', 1), '\s+', ' ', 'g')) AS title, 'Ann B. Lee' AS author,
 'Short words ' || doc_id || ' of work and so on.' AS abstract, 1::BIGINT AS n_references FROM t""")
def thesis_fields(spark, d):
    """Title, author, abstract and references of a thesis."""
    c = F.col("thesis")
    return _theses(spark, d).select("doc_id", thesis.title(c).alias("title"), thesis.author(c).alias("author"), thesis.abstract(c).alias("abstract"), F.size(thesis.references(c)).cast("long").alias("n_references"))


@query()
def thesis_chapters(spark, d):
    """Chapters of a thesis behind its front matter."""
    made = thesis.chapters(thesis.body(thesis.strip_front(F.col("thesis"))))
    return _theses(spark, d).select("doc_id", F.posexplode(made).alias("ord", "s")).select("doc_id", "ord", "s.*")


@query()
def separated_references(spark, d):
    """Bibliographies split from the sections of extracted texts, continued ones merged."""
    found = references.separate_references(pdf_text.sections(F.col("pdf")))
    r = synth.manuscripts(spark, d).select("doc_id", found.alias("r"))
    return r.select("doc_id", F.size("r.sections").alias("n_sections"), F.to_json("r.sections").alias("sections"), F.to_json("r.references").alias("entries"))


@query()
def marked_subsections(spark, d):
    """Lettered subsections marked in every text."""
    return _docs(spark, d).select("doc_id", stateful.mark_subsections(text("text")).alias("marked"))


@query(r"""WITH {m} SELECT doc_id, array_to_string(regexp_extract_all(latex, '\\newcommand\{[^\n]*'), '|') AS macros FROM m""")
def custom_macros(spark, d):
    """Macro definitions of each manuscript's preamble."""
    preamble = F.substring_index("latex", "\\begin{document}", 1)
    return synth.manuscripts(spark, d).select("doc_id", F.array_join(stateful.custom_macros(preamble), "|").alias("macros"))


@query(r"""WITH {m}, r AS (SELECT doc_id, regexp_extract(pdf, '(?s)\nREFERENCES\n\[1\] ([^\n]*)\.\n', 1) AS raw FROM m)
SELECT doc_id, 'article' AS kind, regexp_extract(raw, '^(.*), "', 1) AS author, regexp_extract(raw, '"([^"]*),"', 1) AS title, regexp_extract(raw, '" (Journal[^,]*)', 1) AS journal, '' AS booktitle, '' AS note FROM r""")
def citation_split(spark, d):
    """Kind, author, title and venue of the first citation of each extracted text."""
    raw = F.get(pdf_text.reference_entries(F.regexp_extract("pdf", r"(?s)\nREFERENCES\n(.*)$", 1)), 0)["raw"]
    return synth.manuscripts(spark, d).select("doc_id", references.split_citation(raw).alias("c")).select("doc_id", "c.*")


@query()
def equation_residue(spark, d):
    """Every text without the residue of displayed equations."""
    return artifacts.remove_equation_residue(_docs(spark, d).select("doc_id", text("text").alias("cleaned")), "cleaned")


@query()
def linear_equations(spark, d):
    """The lines of each text folded as an equation's lines are, and their number."""
    return _docs(spark, d).select("doc_id", artifacts.linearize(lines_of(F.col("text"))).alias("line"), artifacts.equation_number(lines_of(F.col("text"))).alias("found"))


@query("WITH {m}, " + _PARSE + """, a AS (SELECT doc_id, 'e' AS label FROM documents) SELECT a.doc_id, a.label, 'Method' AS section FROM a""")
def placed_artifacts(spark, d):
    """The section of an equation by its anchor, else of what mentions it."""
    s = synth.manuscripts(spark, d).select("doc_id", F.explode(latex.sections(F.col("latex"))).alias("s")).select("doc_id", "s.*")
    s = s.withColumn("content", F.when(F.col("title") == "Method", F.concat("content", F.lit(" by Eq. (7)."))).otherwise(F.col("content")))
    a = _docs(spark, d).select("doc_id", *[F.lit(v).alias(k) for k, v in (("label", "e"), ("kind", "equation"), ("number", "7"), ("anchor", ""), ("raw", ""), ("caption", ""), ("fallback", ""))])
    return artifacts.place(a, s).select("doc_id", "label", "section")


@query()
def injected_artifacts(spark, d):
    """Artifacts put behind their anchors, the whole text escaped around them: one behind
    the first sentence, one without an anchor that the text holds."""
    first = F.coalesce(F.get(artifacts.sentences(text("text")), 0), F.lit(""))
    a = F.array(F.struct(F.lit("[F]").alias("latex"), first.alias("anchor")), F.struct(F.lit("[G]").alias("latex"), F.concat(F.lit("nowhere "), F.col("doc_id")).alias("anchor")))
    return _docs(spark, d).select("doc_id", artifacts.inject(text("text"), a, escape=True).alias("text"))


@query()
def scrubbed_snippets(spark, d):
    """Every text without its four longest lines."""
    return _docs(spark, d).select("doc_id", artifacts.remove_snippets(text("text"), artifacts.longest_snippets(lines_of(F.col("text")))).alias("cleaned"))


@query("""SELECT doc_id, 'success' AS status, 3 - (doc_id % 3 = 0)::INT AS n_sections FROM documents""")
def converted(spark, d):
    """Whole conversions to ACM: status and size."""
    m = synth.manuscripts(spark, d).withColumn("references", _refs())
    return pipeline.convert_latex(m, "ieee").select("doc_id", "status", "n_sections")


@query()
def conversion_reports(spark, d):
    """Reports of whole conversions."""
    m = synth.manuscripts(spark, d).withColumn("references", _refs())
    return pipeline.convert_latex(m, "ieee").select("doc_id", pipeline.report().alias("report"), "guard", "items")


@query()
def pdf_confidence(spark, d):
    """Confidence of records of extracted texts."""
    return pipeline.pdf_records(synth.manuscripts(spark, d)).select("doc_id", "confidence", F.size("sections").alias("n_sections"))


@query("WITH {m} SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE 'ref1|ref2' END AS keys FROM (SELECT doc_id, 1 AS n FROM m)")
def reference_placeholders(spark, d):
    return synth.manuscripts(spark, d).select("doc_id", F.array_join(F.transform(stateful.reference_placeholders(F.col("pdf")), lambda r: r["key"]), "|").alias("keys"))


@query("""SELECT doc_id, '@article{k' || doc_id || ', title={' || translate(coalesce(text, ''), '{}@', '') || '}, note={A {B} c}}' AS raw, 'k' || doc_id AS key FROM documents""")
def bib_entries(spark, d):
    """Entries of BibTeX texts that hold the whole text, with nested braces, junk and an open entry."""
    plain = F.translate(text("text"), "{}@", "")
    t = F.concat(F.lit("junk @article{k"), F.col("doc_id"), F.lit(", title={"), plain, F.lit("}, note={A {B} c}} @string{nokey} @book{open, x={"))
    return _docs(spark, d).select("doc_id", F.explode(projects.bib_entries(t)).alias("e")).select("doc_id", "e.*")


@query()
def generic_articles(spark, d):
    """A generic article of each text."""
    return _docs(spark, d).select("doc_id", generic.article(text("text"), F.concat(F.lit("doc "), F.col("doc_id"))).alias("main"))


@query()
def preamble_lines(spark, d):
    """The preamble that each manuscript and its packages ask for."""
    none = F.array().cast("array<string>")
    libraries = F.transform(F.regexp_extract_all("latex", F.lit(r"(\\usetikzlibrary\{[^}]*\})"), 1), lambda x: x)
    made = generic.preamble_lines(F.col("latex"), latex.source_packages(F.substring_index("latex", "\\begin{document}", 1)), libraries, none, none)
    return synth.manuscripts(spark, d).select("doc_id", F.array_join(made, "|").alias("lines"))