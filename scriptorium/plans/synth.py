"""Manuscripts made from the ``documents`` table, so that queries over LaTeX and
extracted pages have something to bite on.  They hold the whole text: its first 800
characters are dealt to the first parts, all that follows goes to the last.  The expressions are SQL that Spark and
DuckDB read alike; both engines get the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

B, N = "chr(92)", "chr(10)"
_T = "coalesce(text, '')"
_FLAT = f"replace({_T}, {N}, ' ')"

#: One LaTeX source per document.
LATEX = f"""
(CASE WHEN doc_id % 2 = 0 THEN {B}||'documentclass[conference]{{IEEEtran}}' ELSE {B}||'documentclass[sigconf]{{acmart}}' END || {N}
|| {B}||'usepackage[utf8]{{inputenc, xcolor,graphicx}}' || {N}
|| CASE WHEN doc_id % 7 = 0 THEN {B}||'ccsdesc[500]{{Computing methods}}' || {N} ELSE '' END
|| {B}||'newcommand{{'||{B}||'study}}[1]{{No. '||doc_id||' of {{#1}}}}' || {N}
|| CASE WHEN doc_id % 3 = 0 THEN {B}||'usetikzlibrary{{arrows}}' || {N} ELSE '' END
|| {B}||'begin{{document}}' || {N}
|| {B}||'title{{Study  '||doc_id||' of '||coalesce(source, '')||'}}' || {N}
|| CASE WHEN doc_id % 17 = 0 THEN '' ELSE {B}||'author{{Ann Lee'||(doc_id % 7)||' '||{B}||'and Bo  Ray'||(doc_id % 11)||', Cy Poe}}' || {N} END
|| {B}||'begin{{abstract}}' || {N} || substr({_T}, 1, 250) || {N} || {B}||'end{{abstract}}' || {N}
|| CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN {B}||'begin{{IEEEkeywords}}'||{N}||'alpha, beta; gamma'||{N}||{B}||'end{{IEEEkeywords}}'||{N}
   ELSE {B}||'keywords{{alpha, delta}}'||{N} END
|| {B}||'section{{Introduction}}' || {N} || substr({_T}, 1, 400) || ' ' || {B}||'cite{{ref'||(doc_id % 5)||', ref'||(doc_id % 13)||'}}' || {N}
|| {B}||'section{{Method}}' || {N} || CASE WHEN doc_id % 3 = 0 THEN substr({_T}, 401) ELSE substr({_T}, 401, 400) END || ' ' || {B}||'ref{{fig:'||(doc_id % 4)||'}} '||{B}||'label{{fig:'||(doc_id % 3)||'}} '||{B}||'ref{{tab:'||(doc_id % 2)||'}}' || {N}
|| CASE WHEN doc_id % 3 <> 0 THEN {B}||'section{{Conclusions}}' || {N} || substr({_T}, 801) || {N} ELSE '' END
|| CASE WHEN doc_id % 6 = 0 THEN {B}||'begin{{acks}}Thanks to all.'||{B}||'end{{acks}}' || {N} ELSE '' END
|| {B}||'bibliographystyle{{plain}}' || {N} || {B}||'bibliography{{references}}' || {N} || {B}||'end{{document}}' || {N})
"""

#: One extracted text per document, as a page reader would give it.
PDF = f"""
('IEEE Conference on Computer Communications Workshops' || {N}
|| 'A Study of '||coalesce(source, '')||' Systems number '||doc_id || {N}
|| 'Ann Lee, Bo Ray' || {N} || 'Department of Physics, Example University' || {N} || 'ann'||doc_id||'@example.edu, bo@example.org' || {N}
|| 'Abstract - ' || substr({_FLAT}, 1, 250) || {N} || 'Index Terms - alpha, beta; gamma' || {N}
|| 'I. INTRODUCTION' || {N} || substr({_FLAT}, 1, 400) || ' as [1] and [2] show.' || {N}
|| 'Authorized licensed use limited to: no one. Restrictions apply.' || {N}
|| 'II. METHOD' || {N} || substr({_FLAT}, 401, 400) || {N} || 'Fig. 1. Overview of the whole system design' || {N} || 'TABLE II Results of all the runs' || {N}
|| 'Authorized licensed use limited to: no one. Restrictions apply.' || {N}
|| 'III. CONCLUSION' || {N} || substr({_FLAT}, 801) || {N}
|| 'REFERENCES' || {N} || '[1] A. Author and B. Other'||(doc_id % 5)||', "Title of work '||(doc_id % 97)||'," Journal of Work, vol. '||(doc_id % 9 + 1)||', no. 2, pp. '||(doc_id % 40)||'-'||(doc_id % 40 + 9)||', '||(1990 + doc_id % 30)||'.' || {N} || '[2] B. Other, Some later paper title, 2010.' || {N})
"""

#: Keys of the bibliography that comes with every document.
N_REFERENCES = 9


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, latex, pdf, n_refs)`` of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id", f"{LATEX} AS latex", f"{PDF} AS pdf")


#: The same relation for DuckDB, as a common table expression named m.
CTE = f"m AS (SELECT doc_id, {LATEX} AS latex, {PDF} AS pdf FROM documents)"

#: Positioned lines: 40 to a page, in two columns and across, of a page 600 wide.
LINES_SQL = f"""
SELECT doc_id, p // 40 AS page, p % 40 AS ord, line AS text,
  (CASE WHEN p % 3 = 0 THEN 40 WHEN p % 3 = 1 THEN 330 ELSE 150 END)::DOUBLE AS x0, (12 * (p % 40))::DOUBLE AS y0,
  (CASE WHEN p % 3 = 0 THEN 280 WHEN p % 3 = 1 THEN 560 ELSE 450 END)::DOUBLE AS x1, (12 * (p % 40) + 10)::DOUBLE AS y1
FROM (SELECT doc_id, trim(u.line) AS line, u.i - 1 AS p
  FROM (SELECT doc_id, unnest(list_transform(string_split(pdf || coalesce(text, ''), chr(10)), lambda x, i: {{'line': x, 'i': i}})) AS u
        FROM m JOIN documents USING (doc_id)))
"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page, ord, text, x0, y0, x1, y1)`` of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id", f"posexplode(split({PDF} || coalesce(text, ''), {N})) AS (p, line)").selectExpr(
        "doc_id",
        "CAST(p DIV 40 AS BIGINT) AS page",
        "CAST(p % 40 AS BIGINT) AS ord",
        "trim(line) AS text",
        "CAST(CASE WHEN p % 3 = 0 THEN 40 WHEN p % 3 = 1 THEN 330 ELSE 150 END AS DOUBLE) AS x0",
        "CAST(12 * (p % 40) AS DOUBLE) AS y0",
        "CAST(CASE WHEN p % 3 = 0 THEN 280 WHEN p % 3 = 1 THEN 560 ELSE 450 END AS DOUBLE) AS x1",
        "CAST(12 * (p % 40) + 10 AS DOUBLE) AS y1",
    )
