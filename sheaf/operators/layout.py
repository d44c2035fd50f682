"""Spans and boxes of pages to ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overlaps(a: str, b: str) -> Column:
    """Closed boxes that share a point (L1)."""
    c = lambda t, x: F.col(f"{t}.{x}")
    return (c(a, "x0") <= c(b, "x1")) & (c(a, "x1") >= c(b, "x0")) & (c(a, "y0") <= c(b, "y1")) & (c(a, "y1") >= c(b, "y0"))


def in_boxes(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc, page, box_ord, text): each span in the first box it overlaps, spans of a box in (y, x) order, joined by spaces (L2)."""
    s, b = spans.alias("s"), boxes.alias("b")
    x = s.join(b, (F.col("s.doc") == F.col("b.doc")) & (F.col("s.page") == F.col("b.page")) & overlaps("s", "b"))
    first = x.groupBy("s.doc", "s.page", "s.ord").agg(F.min_by(F.struct("b.box_ord", "b.label", "s.y0", "s.x0", "s.text"), "b.box_ord").alias("r")).select("doc", "page", "ord", "r.*")
    g = first.groupBy("doc", "page", "box_ord", "label").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "text"))).alias("t"))
    return g.select("doc", "page", "box_ord", F.concat(F.when(F.col("label") == "SectionHeader", "## ").otherwise(""), F.array_join(F.col("t.text"), " ")).alias("text"))


def headings(spans: DataFrame) -> DataFrame:
    """(doc, size, level): the modal size is body; the largest is H1, and, of two or more larger sizes, those from 2/3 and 1/3 of the range up H2 and H3 (L3)."""
    n = spans.withColumn("size", F.round("font_size").cast("int")).groupBy("doc", "size").agg(F.count("*").alias("n"))
    base = n.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("base"), F.max("size").alias("top"))
    x = n.join(base, "doc").withColumn("larger", F.sum((F.col("size") > F.col("base")).cast("int")).over(W.partitionBy("doc")))
    step = (F.col("top") - F.col("base")) / 3
    level = F.when(F.col("size") <= F.col("base"), 0).when(F.col("size") == F.col("top"), 1).when(F.col("size") >= F.col("base") + 2 * step, 2).when(F.col("size") >= F.col("base") + step, 3).otherwise(0)
    return x.select("doc", "size", F.when((F.col("larger") < 2) & (F.col("size") < F.col("top")), 0).otherwise(level).alias("level"))


def fixed_heading(size: Column) -> Column:
    """Heading level by a fixed ladder of sizes."""
    return F.when(size > 18, 1).when(size > 16, 2).when(size > 14, 3).when(size > 12, 4).otherwise(0)


def flipped(spans: DataFrame, heights: DataFrame) -> DataFrame:
    """Spans with the vertical axis turned over by the height of their page."""
    x = spans.join(heights, ["doc", "page"])
    return x.withColumns({"y0": F.col("height") - F.col("y1"), "y1": F.col("height") - F.col("y0")}).drop("height")


def line_text(spans: DataFrame, line: str = "line") -> DataFrame:
    """(doc, page, line, text): spans of a line from left to right, a `&nbsp;` for each 5 points of a gap over 10, bold and italic from flag bits 16 and 2 (L4)."""
    w = W.partitionBy("doc", "page", line).orderBy("x0", "ord")
    gap = F.col("x0") - F.lag("x1").over(w)
    pad = F.when(gap > 10, F.expr("repeat('&nbsp;', cast(gap / 5 as int))")).otherwise("")
    mark = F.concat(F.when(F.col("flags").bitwiseAND(16) > 0, "**").otherwise(""), F.when(F.col("flags").bitwiseAND(2) > 0, "*").otherwise(""))
    x = spans.withColumn("gap", gap).withColumn("t", F.concat(pad, mark, "text", F.reverse(mark)))
    g = x.groupBy("doc", "page", line).agg(F.array_sort(F.collect_list(F.struct("x0", "ord", "t"))).alias("ts"))
    return g.select("doc", "page", line, F.array_join(F.col("ts.t"), "").alias("text"))


def page_order(*kinds: DataFrame) -> DataFrame:
    """(doc, page, kind, ord, place): elements of all kinds, each (doc, page, kind, ord, x0, y0), in order down and across their page."""
    x = kinds[0]
    for k in kinds[1:]:
        x = x.unionByName(k)
    return x.select("doc", "page", "kind", "ord", F.row_number().over(W.partitionBy("doc", "page").orderBy("y0", "x0", "kind", "ord")).alias("place"))


def pipe_table(rows: Column) -> Column:
    """A grid (array of arrays of strings) as a pipe table: all-empty rows dropped, cells cleaned, rows padded to the widest."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(full, F.size)), F.lit(0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    drawn = F.transform(full, line)
    return F.when(F.size(full) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, F.lit(2), F.size(full))), "\n"))
