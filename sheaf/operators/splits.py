"""Splitting long chunks and merging short ones."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheaf.operators import chunk
from sheaf.session import python_ready

ENDS = [".", "?", "!", "。", "\n"]
#: Separators tried from the first on; the character after one stays with what follows it.
SEPARATORS = ["\n\n", "\n", ". ", ", ", "! ", "? ", "; ", ": ", "- ", "• ", "\t", " "]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentence_end(text: Column, at: Column, window: int = 100) -> Column:
    """The place behind the sentence end nearest to `at`, at most a window away: before it where both are as near; `at` where there is none."""
    low, high = F.greatest(at - window, F.lit(0)), F.least(at + window, F.length(text))
    before, after = F.reverse(F.substring(text, low + 1, at - low)), F.substring(text, at + 1, high - at)
    found = []
    for k, mark in enumerate(ENDS):
        b, a = F.instr(before, mark), F.instr(after, mark)
        found.append(F.when(b > 0, F.struct((b - 1).alias("far"), F.lit(2 * k).alias("k"), (at - b + 1).alias("to"))))
        found.append(F.when(a > 0, F.struct(a.alias("far"), F.lit(2 * k + 1).alias("k"), (at + a).alias("to"))))
    return F.coalesce(F.array_min(F.array(*found)).to, at)


WHITE = " \t\n\x0b\f\r"
_INK = re.compile(f"[^{WHITE}]")


def nearest_end(text: str, at: int, window: int = 100) -> int:
    """As sentence_end, on a text at hand."""
    at = max(at, 0)
    low = max(at - window, 0)
    before, after = text[low:at], text[at : at + window]
    found = []
    for k, mark in enumerate(ENDS):
        if (b := before.rfind(mark)) >= 0:
            found.append((len(before) - b - 1, 2 * k, low + b + 1))
        if (a := after.find(mark)) >= 0:
            found.append((a + 1, 2 * k + 1, at + a + 1))
    return min(found)[2] if found else at


def sliding_pieces(text: str, size: int = 500, overlap: int = 75, least: int = 80) -> list[str]:
    """One text in pieces as `sliding` says. Every step looks at its own piece and goes on by size - overlap less two windows at least, so the cost is that of the text's length."""
    n = len(text)
    if n <= size:
        return [text]
    solid, ink, at, pieces = len(text.rstrip(WHITE)), 0, 0, []
    while True:
        goal = min(at + size, n)
        end = nearest_end(text, goal) if goal < n else goal
        to = nearest_end(text, max(end - overlap, at))
        if ink < to:
            ink = m.start() if (m := _INK.search(text, to)) else n
        done = end >= n or 0 < solid - ink < least
        if p := text[at : n if done else end].strip(WHITE):
            pieces.append(p)
        if done:
            break
        at = to
    if len(pieces) > 1 and len(pieces[-1]) < least:
        *pieces, prev, last = pieces
        cut = nearest_end(prev, len(prev) - least)
        pieces += [prev[:cut].strip(WHITE), f"{prev[cut:]} {last}".strip(WHITE)] if cut > least else [f"{prev} {last}".strip(WHITE)]
    return pieces


def _sliding(size, overlap, least):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else sliding_pieces(t, size, overlap, least) for x in texts], pa.list_(pa.string()))

    return run


def sliding(text: Column, size: int = 500, overlap: int = 75, least: int = 80) -> Column:
    """text as an array of pieces of about `size`, cut at sentence ends, each starting about `overlap` before the last one's end.

    A rest below `least` joins the piece before; a last piece below it is filled up from the one before, or joined to it.
    """
    python_ready()
    return F.arrow_udf(_sliding(size, overlap, least), "array<string>")(text)


def split_large(chunks: DataFrame, key: str = "chunk_id", content: str = "content", size: int = 500) -> DataFrame:
    """chunks with those over `size` in pieces, each with the id {id}_split_{i}."""
    x = chunks.withColumn("_p", sliding(F.col(content), size)).withColumn("_n", F.size("_p"))
    x = x.select(*[c for c in chunks.columns if c != content], "_n", F.posexplode("_p").alias("_i", content))
    return x.withColumn(key, F.when(F.col("_n") > 1, F.concat_ws("_split_", F.col(key).cast("string"), F.col("_i").cast("string"))).otherwise(F.col(key).cast("string"))).select(chunks.columns)


def merge_small(chunks: DataFrame, key: str = "doc_id", order: str = "pos", least: int = 50) -> DataFrame:
    """chunks (key, order, level, content, keywords, page_num) where one of fewer than `least` characters takes in the next of its level.

    Level 1 is never merged. A merged pair is not merged on: of a run of chunks that could each take in the next, every second one does.
    """
    by = W.partitionBy(key).orderBy(order)
    x = chunks.withColumn("_takes", F.coalesce((F.col("level") > 1) & (F.length("content") < least) & (F.lead("level").over(by) == F.col("level")), F.lit(False)))
    x = x.withColumn("_k", F.row_number().over(by)).withColumn("_stop", F.coalesce(F.max(F.when(~F.col("_takes"), F.col("_k"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_first", F.col("_takes") & ((F.col("_k") - F.col("_stop")) % 2 == 1))
    x = x.withColumn("_gone", F.coalesce(F.lag("_first").over(by), F.lit(False)))
    both = lambda c: F.when(F.col("_first"), F.concat(c, F.lead(c).over(by))).otherwise(F.col(c))
    x = x.withColumns({"content": F.when(F.col("_first"), F.concat("content", F.lit("\n\n"), F.lead("content").over(by))).otherwise(F.col("content")), "keywords": both("keywords"), "page_num": F.array_sort(F.array_distinct(both("page_num")))})
    return x.where(~F.col("_gone")).select(chunks.columns)


def page_list(content: Column, section: Column) -> Column:
    """Pages of a section of a document: the last marker before its first line, and the markers within its length; [1] where there is none."""
    at = F.instr(content, F.trim(F.split(section, "\n")[0]))
    pages = lambda s: F.regexp_extract_all(s, F.lit(chunk.MARKER), 1).cast("array<int>")
    found = F.array_sort(F.array_distinct(F.concat(F.slice(F.reverse(pages(F.substring(content, F.lit(1), at - 1))), 1, 1), pages(F.substring(content, at, F.length(section))))))
    return F.when((at > 0) & (F.size(found) > 0), found).otherwise(F.array(F.lit(1)))


def recursive(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """text in pieces of at most `size`: cut at the first separator it holds, longer parts at the later ones; parts are put together
    up to `size`, and each piece starts with the last parts of the one before, up to `overlap`."""
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return [text.strip()] if text.strip() else []
    first, *others = text.split(separators[at])
    parts = [p for p in [first, *(separators[at] + p for p in others)] if p]
    out: list[str] = []
    held: list[str] = []

    def close():
        if joined := "".join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) > size:
            close()
            held.clear()
            out += recursive(p, separators[at + 1 :], size, overlap)
            continue
        if held and sum(map(len, held)) + len(p) > size:
            close()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    close()
    return out


def _recursive(separators, size, overlap):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([recursive(t.as_py() or "", separators, size, overlap) for t in texts], pa.list_(pa.string()))

    return run


def recursive_pieces(text: Column, size: int = 1000, overlap: int = 200, separators: list[str] | None = None) -> Column:
    """An array of the pieces of each whole text."""
    python_ready()
    return F.arrow_udf(_recursive(separators or SEPARATORS, size, overlap), "array<string>")(text)


def recursive_chunks(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, chunk, start, end, text) of documents without headers; the place is where the piece is found first, (0, 0) where it isn't."""
    x = docs.where(~F.col(content).rlike(r"(?m)^#{1,6}\s")).withColumn("_p", recursive_pieces(F.col(content))).select(key, content, F.posexplode("_p").alias("chunk", "text"))
    at = F.instr(F.col(content), F.col("text"))
    return x.select(key, "chunk", F.greatest(at - 1, F.lit(0)).alias("start"), F.when(at > 0, at + F.length("text") - 2).otherwise(0).alias("end"), "text")


def hybrid(docs: DataFrame, key: str = "doc_id", content: str = "content", size: int = 1000, overlap: int = 100, least: int = 300) -> DataFrame:
    """(key, chunk, text): sections at `##` headers, longer ones in pieces, and each chunk below `least` with the next ones as long as both fit."""
    parts = F.filter(F.transform(F.split(content, r"(?m)(?=^##\s)"), strip), lambda s: s != "")
    x = docs.select(key, F.posexplode(parts).alias("i", "part")).withColumn("p", F.when(F.length("part") <= size, F.array("part")).otherwise(recursive_pieces(F.col("part"), size, overlap, ["\n\n", "\n", " "])))
    pieces = x.groupBy(key).agg(F.flatten(F.array_sort(F.collect_list(F.struct("i", "p")))["p"]).alias("ps"))
    begin = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("out"))

    def take(s, p):
        fits = (F.length(s.held) < least) & (F.length(s.held) + 1 + F.length(p) <= size)
        return F.when(s.held.isNull(), F.struct(p.alias("held"), s.out.alias("out"))).when(fits, F.struct(F.concat(s.held, F.lit("\n"), p).alias("held"), s.out.alias("out"))).otherwise(F.struct(p.alias("held"), F.concat(s.out, F.array(s.held)).alias("out")))

    merged = F.aggregate("ps", begin, take, lambda s: F.concat(s.out, F.array(s.held)))
    return pieces.select(key, F.posexplode(merged).alias("chunk", "text"))
