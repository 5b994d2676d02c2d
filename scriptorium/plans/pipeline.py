"""A whole conversion as one lazy plan: parse, guard, normalise, render, harmonise,
validate, report; and the sink that writes its files."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import convert, latex, layout, pdf_text



def _complete(records: DataFrame) -> DataFrame:
    """Fields that a reader doesn't fill, empty."""
    kinds = {"emails": S.STRINGS, "affiliations": S.STRINGS, "ccs_concepts": S.STRINGS, "figures": S.VISUALS, "tables": S.VISUALS, "references": S.REFERENCES}
    return records.withColumns(
        {n: F.array().cast(t) for n, t in kinds.items() if n not in records.columns}
        | {n: F.lit("") for n in ("acknowledgments", "ccsxml") if n not in records.columns}
    )


def convert_latex(
    projects: DataFrame, source: str, compiled: Column | None = None, hook: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``projects`` (doc_id, latex, references) to the other venue.

    Adds main_tex, bib, guard, warnings, items (to be reviewed), validation, status.
    ``hook`` may rewrite the rendered text before validation; ``compiled`` is a
    column of compiler outcomes where a compiler ran.
    """
    target = convert.TARGETS[source]
    records = convert.normalize(_complete(latex.parse(projects)))
    text = convert.harmonize(convert.render_main(target))
    known = F.transform("references", lambda r: r["key"])
    return (
        records.withColumn("main_tex", hook(text) if hook else text)
        .withColumn("validation", convert.validate(F.col("main_tex"), F.col("sections"), known, target))
        .select(
            *projects.columns,
            "title",
            F.size("sections").alias("n_sections"),
            "main_tex",
            convert.render_bib(F.col("references")).alias("bib"),
            latex.format_guard(F.col("latex"), source).alias("guard"),
            convert.normalization_warnings(target).alias("warnings"),
            convert.unresolved_items(target).alias("items"),
            "validation",
            convert.final_status(F.col("validation.template"), compiled if compiled is not None else F.lit("not_run"), F.lit(compiled is not None)).alias("status"),
        )
    )


def pdf_records(texts: DataFrame) -> DataFrame:
    """Records of extracted texts, with their confidence."""
    parsed = pdf_text.parse(texts)
    return _complete(parsed.withColumn("authors", F.array().cast(S.STRINGS))).withColumn("confidence", convert.confidence())


def trace(results: DataFrame) -> DataFrame:
    """One JSON line a document: what a run did."""
    return results.select(F.to_json(F.struct("doc_id", "title", "n_sections", "guard", "warnings", "items", "validation", "status")).alias("value"))


def report() -> Column:
    """A Markdown report of one conversion."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("Status: "), F.col("status")), F.lit("## Warnings"), bullets("warnings"), F.lit("## To review"), bullets("items"))


def write_projects(results: DataFrame, folder: str) -> None:
    """Write main file and bibliography of each document, in a folder of its own."""
    files = results.select(
        F.col("doc_id").alias("job"),
        F.explode(F.array(F.struct(F.lit("main.tex").alias("name"), F.col("main_tex").alias("value")), F.struct(F.lit("references.bib").alias("name"), F.col("bib").alias("value")))).alias("f"),
    ).select("job", "f.*")
    files.write.mode("overwrite").partitionBy("job", "name").option("lineSep", "\n").text(folder)


def page_visuals(lines: DataFrame, boxes: DataFrame, width: float) -> DataFrame:
    """Figures, equations and their anchors of pages, in source order."""
    anchor = layout.anchors(lines, width).select("doc_id", "page", "ord", "anchor")
    figures = layout.figure_regions(lines, boxes, width).select("doc_id", "page", F.col("c_ord").alias("ord"), F.lit("figure").alias("kind"), "x0", "y0", "x1", "y1")
    equations = layout.equation_regions(lines, width).select("doc_id", "page", F.col("first").alias("ord"), F.lit("equation").alias("kind"), "x0", "y0", "x1", "y1")
    found = figures.unionByName(equations).join(anchor, ["doc_id", "page", "ord"], "left")
    return found.withColumn("source_order", F.col("page") * 10000 + F.floor("y0").cast("long") * 10)
