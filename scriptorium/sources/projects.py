"""LaTeX projects as files: listing, entry file, includes, bibliographies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S

BEGIN = r"\begin{document}"
INCLUDE = r"\\(?:input|include)\{([^}]+)\}"


def read_projects(spark: SparkSession, root: str, glob: str = "*.{tex,bib}") -> DataFrame:
    """``(project, rel_path, content)`` of all projects below ``root``, one a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.regexp_replace("_metadata.file_path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return files.select(F.substring_index(path, "/", 1).alias("project"), F.regexp_replace(path, "^[^/]*/", "").alias("rel_path"), F.col("value").alias("content"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size_bytes, suffix, sha256)`` of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("sha256"))


def entry_files(files: DataFrame, prefer_main: bool = False) -> DataFrame:
    """The entry file of each project: root files first, those that begin a document
    first, then path order.  With ``prefer_main`` a root ``main.tex`` wins outright."""
    tex = files.filter(F.col("rel_path").endswith(".tex"))
    keys = [F.contains("rel_path", F.lit("/")), ~F.contains("content", F.lit(BEGIN)), F.col("rel_path")]
    if prefer_main:
        keys.insert(0, F.col("rel_path") != "main.tex")
    rank = F.row_number().over(Window.partitionBy("project").orderBy(*keys))
    return tex.withColumn("rn", rank).filter("rn = 1").drop("rn")


def inline_includes(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``(project, text)``: the entry with its includes spliced in, each file once.

    A project's files meet in one task; a project is small and can't be split,
    since includes nest.  Targets that don't exist stay as they are.
    """
    marked = files.join(entries.select("project", F.col("rel_path").alias("entry")), "project")

    def splice(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(pdf.rel_path, pdf.content))
        seen: set[str] = set()

        def expand(path: str) -> str:
            if path in seen:
                return ""
            seen.add(path)
            folder = path.rpartition("/")[0]

            def one(m: re.Match) -> str:
                name = m.group(1).strip()
                if not name:
                    return ""
                full = f"{folder}/{name}" if folder else name
                for target in (re.sub(r"(\.[^./]*)?$", ".tex", full, count=1) if not full.lower().endswith(".tex") else full, full):
                    if target in texts:
                        return expand(target)
                return m.group(0)

            return re.sub(INCLUDE, one, texts[path])

        return pd.DataFrame({"project": [pdf.project[0]], "text": [expand(pdf.entry[0])]})

    return marked.groupBy("project").applyInPandas(splice, "project string, text string")


@F.pandas_udf(S.REFERENCES)
def bib_entries(raw: pd.Series) -> pd.Series:
    """Entries of a BibTeX text with balanced braces; those without a key are dropped."""

    def scan(text: str) -> list[dict]:
        out, at = [], 0
        while text and (start := text.find("@", at)) >= 0 and (open_ := text.find("{", start)) >= 0:
            depth, end = 0, None
            for m in re.compile(r"[{}]").finditer(text, open_):
                depth += 1 if m.group() == "{" else -1
                if not depth:
                    end = m.end()
                    break
            if end is None:
                break
            entry = text[start:end]
            if key := re.match(r"@\w+\{\s*([^,\s]+)\s*,", entry):
                out.append({"key": key.group(1), "raw": entry.strip()})
            at = end
        return out

    return raw.map(scan)


def flat_bib_entries(raw: Column) -> Column:
    """The same for entries whose braces nest twice at most, without Python."""
    found = F.regexp_extract_all(raw, F.lit(r"(@\w+\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})"), 1)
    made = F.transform(found, lambda e: F.struct(F.regexp_extract(e, r"^@\w+\{\s*([^,\s]+)\s*,", 1).alias("key"), e.alias("raw")))
    return F.filter(made, lambda r: r["key"] != "")


def image_folders(paths: DataFrame) -> DataFrame:
    """Distinct folders with images, and ``./`` for each project."""
    images = paths.filter(F.lower("rel_path").rlike(r"\.(png|jpe?g|pdf|eps|svg)$")).select(
        "project", F.concat(F.regexp_replace("rel_path", "[^/]*$", "")).alias("folder")
    )
    folders = images.select("project", F.when(F.col("folder") == "", "./").otherwise(F.col("folder")).alias("folder"))
    return folders.union(paths.select("project", F.lit("./"))).distinct()


def unique_basenames(paths: DataFrame) -> DataFrame:
    name = F.regexp_extract("rel_path", "([^/]+)$", 1)
    return paths.groupBy("project", name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("rel_path")).filter("n = 1").drop("n")


def largest_bib(files: DataFrame) -> DataFrame:
    """The largest bibliography of each project, the first path of equals."""
    rank = Window.partitionBy("project").orderBy(F.desc("size_bytes"), "rel_path")
    return files.filter(F.col("rel_path").endswith(".bib")).withColumn("rn", F.row_number().over(rank)).filter("rn = 1").drop("rn")
