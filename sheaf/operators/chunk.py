"""From page-marked markdown to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MARKER = r">>> page_(\d+)"


def page_spans(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, page_num, start, end): a page from its marker on; the last ends at the text's length, others one before the next (B1)."""
    parts = docs.select(key, F.posexplode(F.split(content, r"(?=>>> page_\d+)")).alias("pos", "part"), F.length(content).alias("total"))
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    x = parts.withColumn("start", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)).cast("int")).where(F.col("part").rlike("^" + MARKER))
    after = F.lead("start").over(W.partitionBy(key).orderBy("pos"))
    return x.select(key, F.regexp_extract("part", MARKER, 1).cast("int").alias("page_num"), "start", F.coalesce(after - 1, F.col("total")).cast("int").alias("end"))


def blank_markers(content: Column) -> Column:
    """Page markers as spaces of equal length, so that offsets hold (B2)."""
    parts = F.split(content, r"(?=>>> page_\d+)")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.rpad(F.lit(""), F.length(F.regexp_extract(p, r"^(>>> page_\d+)", 1)), " "), F.regexp_replace(p, r"^>>> page_\d+", ""))), "")


def images(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, ord, content: target, metadata: caption) of each image."""
    p = F.lit(r"(?s)!\[(.*?)\]\((.*?)\)")
    both = F.arrays_zip(F.regexp_extract_all(content, p, 2).alias("target"), F.regexp_extract_all(content, p, 1).alias("caption"))
    return docs.select(key, F.posexplode(both).alias("ord", "z")).select(key, "ord", F.col("z.target").alias("content"), F.col("z.caption").alias("metadata"))


def lines(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, pos, line)."""
    return docs.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "line"))


def attribute_pages(chunks: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks (key, chunk, start, end) with page_num: the pages from that of the start to that of the end, 0 where none matches; [0] for one at (0, 0), which has no place.

    The interval join has the document as its equality key.
    """
    c, p = chunks.withColumnsRenamed({"start": "c_start", "end": "c_end"}), pages.select(F.col(key).alias("p_key"), "page_num", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    x = c.join(p, (F.col(key) == F.col("p_key")) & (F.col("p_start") <= F.col("c_end")) & (F.col("p_end") >= F.col("c_start")), "left")
    has = lambda at: F.max(F.when(F.col(at).between(F.col("p_start"), F.col("p_end")), F.col("page_num")))
    g = x.groupBy(key, "chunk", "c_start", "c_end").agg(F.coalesce(has("c_start"), F.lit(0)).alias("a"), F.coalesce(has("c_end"), F.lit(0)).alias("b"))
    placed = F.sequence("a", F.greatest("a", "b"))
    return g.select(key, "chunk", F.when((F.col("c_start") == 0) & (F.col("c_end") == 0), F.array(F.lit(0))).otherwise(placed).alias("page_num"))


def bold(content: Column) -> Column:
    """Keywords in bold."""
    return F.regexp_extract_all(content, F.lit(r"\*\*(.*?)\*\*"), 1)


def row_text(row: Column) -> Column:
    """A table row as `k: v | k: v`."""
    return F.array_join(F.transform(F.map_entries(row), lambda e: F.concat(e.key, F.lit(": "), F.coalesce(e.value, F.lit("")))), " | ")


def squeeze(content: Column) -> Column:
    """Markers out, and three or more line ends down to two."""
    return F.regexp_replace(F.regexp_replace(content, MARKER + r"\n?", ""), r"\n{3,}", "\n\n")


def running_lines(pages: DataFrame, key: str = "doc_id", page: str = "page", share: float = 0.3) -> DataFrame:
    """(key, zone, line): lines of the first or last 30 % of every page, present on each page but the first of three or more.

    pages has (key, page, pos, line); page counters such as 3/15 count as one line.
    """
    x = pages.withColumn("line", F.regexp_replace(F.trim("line"), r"^(\d+)\s*/\s*(\d+)$", "n/$2")).where("line <> ''")
    by = W.partitionBy(key, page)
    x = x.withColumn("k", F.row_number().over(by.orderBy("pos"))).withColumn("n", F.count("*").over(by))
    size = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    zones = x.where(F.col("k") <= size).withColumn("zone", F.lit("header")).unionByName(x.where(F.col("k") > F.col("n") - size).withColumn("zone", F.lit("footer")))
    of = x.groupBy(key).agg(F.count_distinct(page).alias("pages"), F.min(page).alias("first"))
    z = zones.join(of, key).where("pages > 1 and (pages < 3 or " + page + " <> first)")
    g = z.groupBy(key, "zone", "line").agg(F.count_distinct(page).alias("on"), F.max("pages").alias("pages"))
    return g.where(F.col("on") == F.when(F.col("pages") >= 3, F.col("pages") - 1).otherwise(F.col("pages"))).select(key, "zone", "line")


URL = r"https?://[^\s<>\"')\]]+"


def links(docs: DataFrame, key: str = "doc_id", content: str = "content", around: int = 100) -> DataFrame:
    """(key, ord, content: URL, metadata: the characters before and after it) of every occurrence of a URL (B4). Offsets stay within the row."""
    parts = F.split(content, r"(?=https?://)")
    starts = F.aggregate(F.transform(parts, F.length), F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    one = lambda z: F.struct(F.regexp_extract(z.p, "^" + URL, 0).alias("url"), z.s.alias("at"))
    found = F.filter(F.transform(F.arrays_zip(parts.alias("p"), F.slice(starts, 1, F.size(parts)).alias("s")), one), lambda z: z.url != "")
    low = lambda z: F.greatest(z.at - around, F.lit(0))
    cut_out = F.transform(found, lambda z: F.struct(z.url.alias("content"), F.concat(F.substring(F.col(content), low(z) + 1, z.at - low(z)), F.substring(F.col(content), z.at + F.length(z.url) + 1, F.lit(around))).alias("metadata")))
    return docs.select(key, F.posexplode(cut_out).alias("ord", "z")).select(key, "ord", "z.*")


def pipe_tables(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, start, content): maximal runs of lines that start with a pipe, with pipes and dashes as spaces."""
    l = lines(docs, key, content).where(F.ltrim("line").startswith("|"))
    l = l.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy(key).orderBy("pos")))
    g = l.groupBy(key, "run").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return g.select(key, "start", F.translate(F.array_join(F.col("ls.line"), "\n"), "|-", "  ").alias("content"))


def json_rows(table: Column) -> Column:
    """Rows of a table given as JSON objects, one a line, with or without a comma at the end; other lines are skipped."""
    each = F.transform(F.split(table, "\n"), lambda x: F.from_json(F.regexp_replace(F.trim(x), r",\s*$", ""), "map<string,string>"))
    return F.filter(each, lambda m: m.isNotNull() & (F.size(m) > 0))


def clean_sheet(content: Column) -> Column:
    """A safety sheet without repeated titles, versions, dates, image tags, page lines and lone tags."""
    x = F.regexp_replace(content, r"(?i)(?:SAFETY\s+DATA\s+SHEET|물질안전보건자료|Version\s+\d+\.\d+|(?:Revision|Print)\s+Date\s+[^\n]*)\s*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"!\[.*?\]\(.*?\)", ""), r"(?i)\[\s*Image\s+of\s+.*?\]", "")
    drop = r"^\s*\d+\s*/\s*\d+\s*$|^\s*>{2,}\s*page[ _-]\d+\s*$|^\s*</?[A-Za-z][^>]*>\s*$"
    return F.array_join(F.filter(F.split(x, "\n"), lambda line: ~F.rlike(line, F.lit(drop))), "\n")


def without_lines(lines_: DataFrame, running: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): documents without their running lines (B26). lines_: (key, pos, line)."""
    gone = running.select(key, F.col("line").alias("_n")).distinct()
    kept = lines_.withColumn("_n", F.regexp_replace(F.trim("line"), r"^(\d+)\s*/\s*(\d+)$", "n/$2")).join(gone, [key, "_n"], "left_anti")
    g = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return g.select(key, F.array_join(F.col("ls.line"), "\n").alias("content"))


def between(content: Column, start: str, end: str) -> Column:
    """The text from one header to the next, white space in them flexible and `#` optional: null without a start, to the end without an end."""
    flexible = lambda h: r"#*\s*" + r"\s+".join(rf"\Q{w}\E" for w in h.split())
    a = F.regexp_instr(content, F.lit(flexible(start)))
    tail = F.substring(content, a, F.length(content))
    b = F.regexp_instr(tail, F.lit(flexible(end)))
    return F.when(a > 0, F.when(b > 1, F.substring(tail, F.lit(1), b - 1)).otherwise(tail))
