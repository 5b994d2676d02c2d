"""Convert a folder of LaTeX projects: ``python -m scriptorium SOURCE INPUT OUTPUT``."""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import pipeline
from .sources import projects


def main() -> None:
    cli = argparse.ArgumentParser(description="Convert LaTeX projects between venue styles.")
    cli.add_argument("source", choices=["ieee", "acm"])
    cli.add_argument("input", help="folder with one project in each subfolder")
    cli.add_argument("output")
    args = cli.parse_args()
    spark = SparkSession.builder.getOrCreate()
    files = projects.read_projects(spark, args.input)
    texts = projects.inline_includes(files.filter("rel_path LIKE '%.tex'"), projects.entry_files(files))
    bibs = files.filter("rel_path LIKE '%.bib' AND NOT contains(rel_path, '/')").groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("bib_text")
    )
    sources = texts.join(bibs, "project", "left").select(
        F.col("project").alias("doc_id"), F.col("text").alias("latex"), projects.bib_entries(F.coalesce("bib_text", F.lit(""))).alias("references")
    )
    results = pipeline.convert_latex(sources, args.source)
    pipeline.write_projects(results, f"{args.output}/final")
    pipeline.trace(results).write.mode("overwrite").text(f"{args.output}/trace")


if __name__ == "__main__":
    main()
