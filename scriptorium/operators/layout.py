"""Positioned page lines: windows, ranges and envelopes by page.

All operators take ``(doc_id, page, ord, text, x0, y0, x1, y1)`` and partition by
document and page, so a long document is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import cleanup, heading

PAGE = ["doc_id", "page"]
ORDER = ["y0", "x0", "ord"]
SESSION_GAP = 42.0


def ordered_lines(blocks: DataFrame) -> DataFrame:
    """Lines of nested page blocks ``(doc_id, page, blocks)`` in reading order.

    blocks: array of (type, lines of (spans of text, x0, y0, x1, y1)); other types
    than 0 and empty lines are left out.
    """
    lines = blocks.select("doc_id", "page", F.explode("blocks").alias("b")).filter("b.type = 0").select("doc_id", "page", F.explode("b.lines").alias("l"))
    flat = lines.select("doc_id", "page", cleanup(F.array_join("l.spans", "")).alias("text"), *[F.col(f"l.{c}") for c in ("x0", "y0", "x1", "y1")]).filter("text <> ''")
    return flat.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "text")) - 1)


def nontext_boxes(images: DataFrame, drawings: DataFrame) -> DataFrame:
    """Boxes of images, and of drawings of two points or more on a side."""
    cols = [*PAGE, "x0", "y0", "x1", "y1"]
    return images.select(*cols).unionByName(drawings.filter((F.col("x1") - F.col("x0") >= 2) | (F.col("y1") - F.col("y0") >= 2)).select(*cols))


def distinct_images(images: DataFrame) -> DataFrame:
    """The first image of each xref, if it is large enough, named in order."""
    first = Window.partitionBy("doc_id", "xref").orderBy("page", "ord", "width")
    place = Window.partitionBy("doc_id", "page").orderBy("ord", "xref")
    big = (F.col("width") >= 120) & (F.col("height") >= 120) & (F.col("width") * F.col("height") >= 24000)
    kept = images.withColumn("rn", F.row_number().over(first)).filter((F.col("rn") == 1) & big).drop("rn")
    return kept.withColumn("name", F.format_string("figure_p%d_%d", F.col("page"), F.row_number().over(place)))


def section_headings(lines: DataFrame) -> DataFrame:
    """As-of join backward: the nearest roman heading at or before each line of its page."""
    is_heading = F.col("text").rlike(r"^[IVX]+\.\s+[A-Z][A-Z\s\-]+$")
    upto = Window.partitionBy(*PAGE).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(F.when(is_heading, heading(F.col("text"))), ignorenulls=True).over(upto), F.lit("")))


def anchors(lines: DataFrame, width: float, n: int = 4) -> DataFrame:
    """For each line, the last ``n`` qualifying lines before it in its column, joined."""
    column = P.column_bucket(F.col("x0"), F.col("x1"), F.lit(width))
    ok = (F.col("text") != "") & ~F.col("text").rlike(r"(?i)^(?:TABLE\s+[IVXLC0-9]+|Fig\.\s*\d+|REFERENCES$)")
    before = Window.partitionBy(*PAGE, "bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("bucket", column).withColumn("k", F.coalesce(F.sum(ok.cast("int")).over(before), F.lit(0)))
    # the k-th qualifying line sees those numbered k-n .. k-1: a join on few rows each
    good = marked.filter(ok).select(*PAGE, "bucket", F.col("k").alias("g"), F.col("text").alias("line"))
    wanted = marked.withColumn("g", F.explode(F.when(F.col("k") > 0, F.sequence(F.greatest(F.lit(0), F.col("k") - n), F.col("k") - 1))))
    joined = wanted.join(good, [*PAGE, "bucket", "g"])
    found = joined.groupBy(*PAGE, "ord").agg(
        cleanup(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "line"))), lambda x: x["line"]), " ")).alias("anchor")
    )
    return lines.join(found, [*PAGE, "ord"], "left").withColumn("anchor", F.coalesce("anchor", F.lit("")))


def gap_sessions(lines: DataFrame, width: float, gap: float = SESSION_GAP) -> DataFrame:
    """Runs of lines in a column with no vertical gap over ``gap``, as envelopes."""
    w = Window.partitionBy(*PAGE, "bucket").orderBy("ord")
    marked = lines.withColumn("bucket", P.column_bucket(F.col("x0"), F.col("x1"), F.lit(width)))
    fresh = F.coalesce((F.col("y0") - F.lag("y1").over(w) > gap), F.lit(True))
    numbered = marked.withColumn("fresh", fresh.cast("int")).withColumn("session", F.sum("fresh").over(w))
    return numbered.groupBy(*PAGE, "bucket", "session").agg(*envelope(), F.count(F.lit(1)).alias("n_lines"))


def envelope() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def figure_regions(lines: DataFrame, boxes: DataFrame, width: float) -> DataFrame:
    """Range join: for each figure caption, the envelope of boxes and short lines in
    the band of 260 points above it, clamped to its column."""
    w = F.lit(width)
    caption = lines.filter(F.col("text").rlike(r"(?i)^(?:Fig\.?|Figure)\s*\d+")).select(
        *PAGE, F.col("ord").alias("c_ord"), *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1")], P.column_bucket(F.col("x0"), F.col("x1"), w).alias("col")
    )
    cols = [*PAGE, "ord", "x0", "y0", "x1", "y1"]
    shapes = boxes.withColumn("ord", F.lit(-1).cast("long")).select(*cols).unionByName(lines.filter(~P.is_not_figure(F.col("text"))).select(*cols))
    top, bottom = F.greatest(F.lit(28.0), F.col("c_y0") - 260), F.col("c_y0") - 2
    hit = caption.join(shapes, PAGE).filter(
        (F.col("ord") < F.col("c_ord")) & P.in_figure_band(F.col("y0"), F.col("y1"), F.col("x0"), F.col("x1"), top, bottom, F.col("col"), w)
    )
    found = hit.groupBy(*PAGE, "c_ord", "c_x0", "c_y0", "c_x1", "col").agg(*envelope())
    left = F.when(F.col("col") == "right", width * 0.5 + 6).otherwise(36.0)
    right = F.when(F.col("col") == "left", width * 0.5 - 6).otherwise(width - 36.0)
    big = lambda a, b, c, d: (F.col(d) - F.col(b) >= 18) & (F.col(c) - F.col(a) >= 24)
    return (
        found.filter(big("x0", "y0", "x1", "y1"))
        .select(
            *PAGE, "c_ord",
            F.greatest(left, F.least(F.col("x0"), F.col("c_x0") - 24)).alias("x0"), F.greatest(F.lit(28.0), F.col("y0") - 4).alias("y0"),
            F.least(right, F.greatest(F.col("x1"), F.col("c_x1") + 24)).alias("x1"), F.least(F.col("c_y0") - 2, F.col("y1") + 4).alias("y1"),
        )
        .filter(big("x0", "y0", "x1", "y1"))
    )


def merge_visuals(text_items: DataFrame, page_items: DataFrame) -> DataFrame:
    """Full outer join by label of captions found in text and on pages.

    Both: the shorter caption that isn't empty, the text's path unless empty, and
    placement H.  Page rows without a partner are appended.
    """
    t = text_items.select("doc_id", "label", F.col("caption").alias("t_caption"), F.col("path").alias("t_path"))
    p = page_items.select("doc_id", "label", F.col("caption").alias("p_caption"), F.col("path").alias("p_path"))
    shorter = (F.col("p_caption") != "") & (
        (F.length("p_caption") < F.length("t_caption")) | F.lower("t_caption").startswith("overview validation")
    )
    both = F.col("t_caption").isNotNull() & F.col("p_caption").isNotNull()
    return t.join(p, ["doc_id", "label"], "full").select(
        "doc_id", "label",
        F.when(F.col("t_caption").isNull() | shorter, F.col("p_caption")).otherwise(F.col("t_caption")).alias("caption"),
        F.coalesce(F.nullif(F.col("t_path"), F.lit("")), F.col("p_path"), F.lit("")).alias("path"),
        F.when(both, "H").otherwise("tbp").alias("placement"),
    )


def attach_assets(figures: DataFrame, images: DataFrame) -> DataFrame:
    """Positional join of figures ``(doc_id, ord, label)`` and images ``(doc_id, ord,
    name)``; surplus images become figures of their own."""
    return figures.join(images, ["doc_id", "ord"], "full").select(
        "doc_id", "ord", F.coalesce("label", F.concat(F.lit("fig:extracted"), F.col("ord") + 1)).alias("label"), F.coalesce("name", F.lit("")).alias("path")
    )


def locate(artifacts: DataFrame, sections: DataFrame) -> DataFrame:
    """Theta join: the first section of the document that contains an artifact's
    snippet or its first twelve words; null where none does."""
    head = F.array_join(F.slice(F.split("snippet", " "), 1, 12), " ")
    a = artifacts.withColumn("head", head)
    hit = a.join(sections.select("doc_id", F.col("ord").alias("s_ord"), F.col("title").alias("s_title"), "content"), "doc_id").filter(
        F.contains("content", "snippet") | F.contains("content", "head")
    )
    first = hit.groupBy("doc_id", "label").agg(F.min_by("s_title", "s_ord").alias("section"))
    return artifacts.join(first, ["doc_id", "label"], "left")


def equation_regions(lines: DataFrame, width: float) -> DataFrame:
    """Regions grown both ways from math lines: stateful, one page at a time.

    Upward a line may be 20 points off the growing envelope, downward 26; lone
    lines need a math neighbour within two rows and 36 points.
    """
    w = F.lit(width)
    flags = lines.withColumns(
        {
            "is_eq": P.is_equation_line(F.col("text"), F.col("x0"), F.col("x1"), w),
            "is_sat": P.is_equation_satellite(F.col("text"), F.col("x0"), F.col("x1"), w),
        }
    ).select(*PAGE, "ord", "text", "x0", "y0", "x1", "y1", "is_eq", "is_sat")

    def related(a, b) -> bool:
        centre = lambda v: (v[0] + v[2]) / 2
        bucket = lambda v: "l" if centre(v) < width * 0.43 else "r" if centre(v) > width * 0.57 else "c"
        return abs(centre(a) - centre(b)) <= width * 0.18 or (a[2] >= b[0] - 24 and a[0] <= b[2] + 84) or bucket(a) == bucket(b)

    def grow(key, pdf):
        import pandas as pd

        rows = pdf.sort_values("ord").reset_index(drop=True)
        box = rows[["x0", "y0", "x1", "y1"]].to_numpy().tolist()
        joins = (rows.is_eq | rows.is_sat).tolist()
        eq, out, taken = rows.is_eq.tolist(), [], 0
        for i in range(len(rows)):
            if i < taken or not eq[i]:
                continue
            lo, hi, env = i, i, list(box[i])

            def widen(k):
                b = box[k]
                env[:] = [min(env[0], b[0]), min(env[1], b[1]), max(env[2], b[2]), max(env[3], b[3])]

            k = i - 1
            while k >= taken and env[1] - box[k][3] <= 20 and joins[k] and related(box[k], env):
                widen(k)
                lo, k = k, k - 1
            k = i + 1
            while k < len(rows) and box[k][1] - env[3] <= 26 and joins[k] and related(box[k], env):
                widen(k)
                hi, k = k, k + 1
            near = any(
                0 <= j < len(rows) and j != i and joins[j] and abs(box[j][1] - box[i][1]) <= 36 and related(box[j], box[i])
                for j in (i - 2, i - 1, i + 1, i + 2)
            )
            taken = hi + 1
            if hi > lo or near:
                raw = " ".join(rows.text[lo : hi + 1])
                out.append((*key, lo, hi - lo + 1, *env, raw))
        return pd.DataFrame(out, columns=["doc_id", "page", "first", "n_lines", "x0", "y0", "x1", "y1", "raw_text"])

    return flags.groupBy(*PAGE).applyInPandas(
        grow, "doc_id long, page long, first long, n_lines long, x0 double, y0 double, x1 double, y1 double, raw_text string"
    )


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans ``(doc_id, lo, hi)`` as one (gaps and islands)."""
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("fresh").over(w)).groupBy("doc_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def tabular(cells: Column) -> Column:
    """Flat cells as a tabular: three columns from six cells on, else two; a part row
    at the end is dropped; under three cells there is no table."""
    n = F.when(F.size(cells) >= 6, 3).otherwise(2)
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(cells) / n).cast("int") - 1), lambda r: F.concat(F.array_join(F.slice(cells, r * n + 1, n), " & "), F.lit(" \\\\")))
    made = F.concat(F.lit("\\begin{tabular}{"), F.expr("''"), F.repeat(F.lit("l"), n), F.lit("}\n"), F.array_join(rows, "\n"), F.lit("\n\\end{tabular}"))
    return F.when(F.size(cells) < 3, F.lit("% reconstructed table unavailable")).otherwise(made)
