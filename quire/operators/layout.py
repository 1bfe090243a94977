"""The geometry of a page and what follows from it: its class, and the route that it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("single_column", "multi_column", "table_heavy", "anomalous")


def layout_class(words: Column, lines_rects: Column, median_width: Column, wide: Column, gutter: Column, ghost: Column) -> Column:
    """The order of the rules matters."""
    columns = (median_width < 0.55) & (wide < 0.30) & (gutter < 0.15)
    return F.when(ghost | (words < 15), "anomalous").when(lines_rects >= 25, "table_heavy").when(columns, "multi_column").otherwise("single_column")


def route(kind: Column, words: Column, rects: Column | None = None, min_words: int = 5, max_rects: int | None = None) -> Column:
    """(route, reason): B by sight, A by text."""
    said = lambda r, why: F.struct(F.lit(r).alias("route"), why.alias("reason"))
    out = F.when(kind == "anomalous", said("B", F.lit("anomalous page"))).when(words < min_words, said("B", F.format_string("%d words", words)))
    if rects is not None and max_rects is not None:
        out = out.when(rects >= max_rects, said("B", F.format_string("%d rectangles", rects)))
    return out.otherwise(said("A", kind))


def page_geometry(words: DataFrame, page: list[str]) -> DataFrame:
    """Of words (page, block, line, x0, x1, width): line spans, the median of their widths in terms of the page,
    the share of wide ones, and how many words cross the middle."""
    crossing = (F.col("x0") <= 0.53 * F.col("width")) & (F.col("x1") >= 0.47 * F.col("width"))
    each = words.groupBy(*page, "block", "line").agg(((F.max("x1") - F.min("x0")) / F.max("width")).alias("span"), F.count(F.lit(1)).alias("n"), F.count_if(crossing).alias("cross"))
    # lines of equal width are counted before anything of a page comes together; its median lies where half of the
    # count is reached
    widths = each.groupBy(*page, "span").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("n"), F.sum("cross").alias("cross"))
    until = F.sum("of").over(Window.partitionBy(*page).orderBy("span"))
    ranked = widths.withColumns({"until": until, "all": F.sum("of").over(Window.partitionBy(*page))})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("until") >= place, F.col("span")))

    half = (at(F.floor((F.col("all") + 1) / 2)) + at(F.floor(F.col("all") / 2) + 1)) / 2
    return ranked.groupBy(*page).agg(
        F.sum("n").alias("n_words"), F.sum("of").alias("n_lines"), half.alias("median_width"),
        (F.sum(F.when(F.col("span") > 0.75, F.col("of")).otherwise(0)) / F.sum("of")).alias("wide"), F.sum("cross").alias("gutter_cross"), (F.sum("cross") / F.sum("n")).alias("gutter_ratio"),
    )


def class_means(rows: DataFrame, kind: str, measures: list[str], digits: int = 3) -> DataFrame:
    """(kind, pages, a mean of each measure) of each class."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("pages"), *[F.round(F.avg(m), digits).alias(m) for m in measures])


def histogram(rows: DataFrame, column: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(class, n), with the classes that nothing falls into."""
    known = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    return known.join(rows.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_mode(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """(group, mode, weight): the value of the largest total weight, the smallest of those that tie."""
    sums = rows.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("_w"), F.col(value))).alias("mode"), F.max("_w").alias("weight"))


def span_text(spans: DataFrame, page: list[str], body: str) -> DataFrame:
    """(page, line, text): spans (text, size, flags, font) of a line joined; dingbats as dashes, headings marked
    where a span is much larger than the body or bold."""
    dingbat = F.when(F.lower("font").contains("dingbat"), F.lit("-")).otherwise(F.col("text"))
    heading = F.max(((F.col("size") > 1.15 * F.col(body)) | (F.col("flags").bitwiseAND(16) > 0)).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("at", dingbat.alias("t"))))
    text = F.array_join(F.transform(listed, lambda x: x["t"]), "")
    return spans.groupBy(*page, "line").agg(F.concat(F.when(heading == 1, F.lit("## ")).otherwise(F.lit("")), text).alias("text"))
