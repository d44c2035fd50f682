"""Keyword, vector and hybrid retrieval over tables of chunks and of queries."""

from __future__ import annotations

import ctypes
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache, reduce
from hashlib import md5
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheaf.session import dealt, python_ready, written

TOKEN = r"[\p{L}\p{N}]+"
#: Rows up to which a side is broadcast; beyond, it is joined by a shuffle.
FEW = 200_000
#: Rules of surfaces and the form they are all rewritten to.
SYNONYMS = """
no, no., num, number, 번호, 넘버 => number
cas no, cas no., cas-no, cas number, cas registry number, 카스번호, 카스 넘버, 카스넘버 => cas number
msds, 엠에스디에스, 물질안전보건자료, sds, 에스디에스 => sds
tds, 티디에스, 기술자료, 기술데이터시트, technical data sheet => technical data sheet
ppm, 피피엠, parts per million => parts per million
wt %, wt%, weight %, 중량%, 중량 퍼센트, 중량퍼센트 => weight percent
vol %, vol%, volume %, 부피%, 부피 퍼센트, 부피퍼센트 => volume percent
flash point, 인화점 => flash point
boiling point, boiling-point, bp, b.p., 끓는점, 비등점 => boiling point
melting point, melting-point, mp, m.p., 녹는점, 융점 => melting point
vapor pressure, vapour pressure, 증기압 => vapor pressure
specific gravity, relative density, 비중, 상대밀도 => specific gravity
flammable, 인화성, 불붙는, 잘타는 => flammable
toxic, 유독성, 독성, 해로운 => toxic
corrosive, 부식성, 부식되는 => corrosive
oxidizer, oxidiser, 산화제, 산화성 => oxidizer
carcinogen, 발암성 => carcinogen
mutagen, 변이원성 => mutagen
reproductive toxin, 생식독성 => reproductive toxin
"""


def near(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if it has at most so many rows: counted, up to that bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def spaced(text: Column) -> Column:
    """The tokens of text as one string, parted by a space."""
    return F.trim(F.regexp_replace(F.lower(text), TOKEN.replace("[", "[^"), " "))


def postings(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, doc_len)."""
    t = chunks.select(F.col(key), tokens(F.col(text)).alias("ts")).select(key, F.size("ts").alias("doc_len"), F.explode("ts").alias("term"))
    return t.groupBy("term", key, "doc_len").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q_id, key, score, rank): the top k of each query.

    The terms of the queries are few, so postings are built for them alone; lengths come from every chunk.
    """
    q = queries.select("q_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    size = chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))
    p = postings(chunks, key, text).join(near(q.select("term").distinct()), "term", "left_semi")
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    x = q.join(df, "term").join(p, "term").crossJoin(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    s = x.groupBy("q_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that a row meets at once where they are too many to be broadcast.
BLOCK = 4096


def against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row beside every query of a stated set: by broadcast while it has few rows, else in blocks, each of which is a key of the join."""
    n = queries.limit(FEW // 20 + 1).count()
    if n <= FEW // 20:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-queries.count() // BLOCK)
    q = queries.withColumn("_block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(q, "_block").drop("_block")


#: Rows of a tile at most, and bytes of its vectors; queries that are compared with a tile at once.
TILE, TILE_BYTES, AT_ONCE = 16384, 8 << 20, 256


def _packed(width: int, size: int):
    """Arrow batches of (id, by, v, list) as rows of up to `size` neighbours of one list: their ids, what they are grouped by, their vectors as one matrix, and the list."""

    def run(batches):
        held, n, last = [], 0, None

        def row(part):
            t = pa.Table.from_batches(part).combine_chunks()
            ids, by, v = (t.column(i).combine_chunks() for i in range(3))
            m = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, by)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([m.tobytes()], pa.binary()), pa.array([last], pa.int32())], ["ids", "bys", "m", "list"])

        for batch in batches:
            lists = batch.column(3).to_numpy()
            ends = [*(np.flatnonzero(np.diff(lists)) + 1), batch.num_rows]
            at = 0
            for end in ends:
                if n and lists[at] != last:
                    yield row(held)
                    held, n = [], 0
                while at < end:
                    last = int(lists[at])
                    part = batch.slice(at, min(size - n, end - at))
                    held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                    if n == size:
                        yield row(held)
                        held, n = [], 0
        if n:
            yield row(held)

    return run


def _closest(width: int, k: int, how: str):
    """Of each tile and block of queries, (q_id, by, key, raw) that may be among the k best of a query and group: those within a margin of the k-th by a matrix product, their value then
    summed in order as SQL's; of equal values the k smallest keys."""

    def pairs(q, v, far):
        """Value by which a larger one is nearer, and the error it may have, rounding to six digits included."""
        for at in range(0, len(q), AT_ONCE):
            some = q[at : at + AT_ONCE]
            s = some @ v.T
            if how == "l2":
                s = 2 * s - far[None, :] - np.einsum("ij,ij->i", some, some)[:, None]
            yield at, s

    def exact(a, b):
        total, qq, vv = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
        for j in range(width):
            x, y = a[:, j], b[:, j]
            if how == "l2":
                total += (x - y) * (x - y)
            else:
                total += x * y
                qq += x * x
                vv += y * y
        return total / np.sqrt(qq * vv) if how == "cosine" else total

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids, bys = (batch.column(c)[i].values for c in (0, 2, 3))
                q, v = (np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(-1, width) for c in (1, 4))
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                codes = pc.fill_null(bys.dictionary_encode(null_encoding="encode").indices, -1).to_numpy()
                far = np.einsum("ij,ij->i", v, v)
                norms = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(far)
                a, b = (q / norms[0][:, None], v / norms[1][:, None]) if how == "cosine" else (q, v)
                scale = 1.0 if how == "cosine" else float(max(norms[0].max(), norms[1].max())) ** 2
                margin = 2e-6 + 1e-10 * scale
                rows = np.argsort(codes, kind="stable")
                groups = np.split(rows, np.nonzero(np.diff(codes[rows]))[0] + 1)
                for group in groups:
                    for at, s in pairs(a, b[group], far[group]):
                        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
                        at_q, at_v = np.nonzero(s >= least[:, None] - margin)
                        at_q, at_v = at_q + at, group[at_v]
                        raw = exact(q[at_q], v[at_v])
                        if how == "dot":  # nothing in common
                            some = raw != 0
                            at_q, at_v, raw = at_q[some], at_v[some], raw[some]
                        if not len(raw):
                            continue
                        by = np.lexsort((order[at_v], raw, at_q))
                        at_q, at_v, raw = at_q[by], at_v[by], raw[by]
                        new = np.r_[True, (np.diff(at_q) != 0) | (np.diff(raw) != 0)]
                        first = np.maximum.accumulate(np.where(new, np.arange(len(raw)), 0))
                        fine = np.arange(len(raw)) - first < k
                        at_q, at_v, raw = at_q[fine], at_v[fine], raw[fine]
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at_q)), bys.take(pa.array(at_v)), ids.take(pa.array(at_v)), pa.array(raw)], ["q_id", "by", "key", "raw"])

    return run


def candidates(queries: DataFrame, vectors: DataFrame, key: str, vector: str, by: str | None, k: int, how: str, lists: str | None = None) -> DataFrame:
    """(q_id, by, key, raw): pairs of a query (q_id, qv) and a row, among them the k nearest of each query and group; how: cosine, inner (product), dot (only of vectors that have something in common) or l2 (squared).
    lists: a column of both, by which only those meet that have the same number; rows of one stand together in their partitions, else tiles are small.

    Vectors are packed in tiles and queries in blocks, within their partitions, and each tile meets each block once, as matrices; only what may be among the best of a tile goes on, so what is
    shuffled is less than the pairs by a factor of TILE / k. Vectors that are null or of another width, or hold nulls or numbers a product has no use for, take the way of plain expressions.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    of_list = (F.col(lists) if lists else F.lit(0)).cast("int").alias("list")
    q = queries.select(F.col("q_id").alias("id"), F.lit(0).alias("by"), F.col("qv").cast("array<double>").alias("v"), of_list)
    x = vectors.select(F.col(key).alias("id"), (F.col(by) if by else F.lit(0)).alias("by"), F.col(vector).cast("array<double>").alias("v"), of_list)
    width = q.agg(F.max(F.size("v"))).first()[0] or 0
    size = dot(F.col("v"), F.col("v"))
    fine = F.coalesce((F.size("v") == width) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c)) & (size < 1e30) & (size > (1e-30 if how == "cosine" else -1.0)), F.lit(False))
    counts = {name: d.agg(F.count("*").alias("n"), F.count_if(~fine).alias("odd")).first() for name, d in (("q", q), ("x", x))}
    of = {name: next(f.dataType.simpleString() for f in d.schema if f.name == c) for name, d, c in (("q", q, "id"), ("x", x, "id"), ("by", x, "by"))}
    rows = max(1, min(TILE, TILE_BYTES // (8 * max(width, 1))))
    pack = lambda d, i, most: d.where(fine).mapInArrow(_packed(width, most), f"ids array<{i}>, bys array<{of['by'] if d is x else 'int'}>, m binary, list int")
    tiles = written(pack(x, of["x"], rows))
    blocks = written(pack(q, of["q"], max(1, rows // 4)).select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), "list"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if lists:
        # A block goes once to each share of its list's tiles, of which there are as many as give every task some.
        some = {r["list"]: r["n"] for r in tiles.groupBy("list").agg(F.count("*").alias("n")).collect()}
        shares = lambda n: min(n, -(-4 * parts // max(1, len(some))))
        share = spark.createDataFrame([(i, shares(n)) for i, n in some.items()], "list int, shares int")
        mine = tiles.join(F.broadcast(share), "list").withColumn("share", F.pmod(F.xxhash64("ids"), F.col("shares")).cast("int")).drop("shares")
        asked = blocks.join(F.broadcast(share), "list").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        each = asked.repartition(parts, "list", "share").join(mine.repartition(parts, "list", "share"), ["list", "share"])
    else:
        each = blocks.drop("list").crossJoin(tiles.repartition(max(1, min(parts, tiles.count()))))
    out = each.select("q_ids", "q_m", "ids", "bys", "m").mapInArrow(_closest(width, k, how), f"q_id {of['q']}, by {of['by']}, key {of['x']}, raw double")
    if counts["q"]["odd"] or counts["x"]["odd"]:
        a, b = F.col("qv"), F.col("v")
        product = lambda: dot(a, b)
        raw = {"cosine": lambda: dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), "inner": product, "dot": product, "l2": lambda: F.aggregate(F.zip_with(a, b, lambda s, t: F.pow(s - t, 2)), F.lit(0.0), lambda s, t: s + t)}[how]()
        asked = q.select(F.col("id").alias("q_id"), F.col("v").alias("qv"), fine.alias("fine"), F.col("list").alias("q_list"))
        meet = (lambda r, s: r.join(s, F.col("list") == F.col("q_list"))) if lists else against
        plain = lambda r, s: meet(r, s.drop("fine")).select("q_id", "by", F.col("id").alias("key"), raw.alias("raw"))
        rest = plain(x.where(~fine), asked).unionByName(plain(x.where(fine), asked.where(~F.col("fine"))))
        out = out.unionByName(rest.where("raw <> 0") if how == "dot" else rest)
    return out


def top_by_cosine(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", by: str = "label", k: int = 5) -> DataFrame:
    """(q_id, by, key, score, rank): the k nearest of each collection to each query, best first (F11). queries: (q_id, qv), a stated set."""
    x = candidates(queries, vectors, key, vector, by, k, "cosine").select("q_id", F.col("by").alias(by), F.col("key").alias(key), F.round("raw", 6).alias("score"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("q_id", by).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def cut_overall(ranked: DataFrame, key: str = "vec_id", k: int = 5) -> DataFrame:
    """The k best over all collections."""
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def top_by_l2(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(q_id, key, similarity, rank) with similarity max(0, 1 - d / 2) of the squared distance d."""
    x = candidates(queries, vectors, key, vector, None, k, "l2").select("q_id", F.col("key").alias(key), F.round("raw", 6).alias("d"))
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("d", key))).where(F.col("rank") <= k)
    return x.select("q_id", key, F.round(F.greatest(F.lit(0.0), 1 - F.col("d") / 2), 6).alias("similarity"), "rank")


def fuse(a: DataFrame, b: DataFrame, key: str, alpha: float = 0.5, k: int = 50) -> DataFrame:
    """(q_id, key, score) by reciprocal ranks, alpha for the first ranking (F16)."""
    x = a.select("q_id", key, F.col("rank").alias("ra")).join(b.select("q_id", key, F.col("rank").alias("rb")), ["q_id", key], "full")
    part = lambda c, w: F.coalesce(F.lit(w) / (60 + F.col(c)), F.lit(0.0))
    x = x.select("q_id", key, F.round(part("ra", alpha) + part("rb", 1 - alpha), 8).alias("score"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k).drop("rank")


def citations(ranked: DataFrame, by: str, snippet: str = "snippet", content: str = "content") -> DataFrame:
    """(q_id, by, first_rank, chunks, snippets, contents): results grouped by document, in order of first sight, with their whole texts."""
    g = ranked.groupBy("q_id", by).agg(F.min("rank").alias("first_rank"), F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("rank", snippet, content))).alias("s"))
    return g.select("q_id", by, "first_rank", "chunks", F.array_join(F.col(f"s.{snippet}"), " | ").alias("snippets"), F.array_join(F.col(f"s.{content}"), "\n").alias("contents"))


def prompts(ranked: DataFrame, queries: DataFrame, content: str = "content") -> DataFrame:
    """(q_id, prompt): the whole contents of the results in rank order, each after its rank and parted by `---`, and the question."""
    g = ranked.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(content).alias("c")))).alias("c"))
    text = F.array_join(F.transform("c", lambda z: F.concat(F.lit("["), z["rank"].cast("string"), F.lit("] "), z["c"])), "\n---\n")
    return g.join(queries.select("q_id", "query"), "q_id").select("q_id", F.concat(text, F.lit("\n\nQuestion: "), "query").alias("prompt"))


def within_budget(ranked: DataFrame, text: str = "text", most: int = 2000) -> DataFrame:
    """Results in rank order until the next would exceed the budget of characters."""
    w = W.partitionBy("q_id").orderBy("rank")
    over = (F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, 0)) > most).cast("int")
    x = ranked.withColumn("_over", over)
    return x.withColumn("_over", F.max("_over").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_over = 0").drop("_over")


def rules(text: str = SYNONYMS) -> dict[str, str]:
    """Rules `a, b => c`, a line each, as surface to form, both as words parted by a space; other lines say nothing."""
    import regex

    words = lambda x: " ".join(regex.findall(TOKEN, x.lower()))
    out = {}
    for line in text.splitlines():
        left, arrow, right = line.partition("=>")
        if arrow:
            out |= {words(x): words(right) for x in left.split(",") if words(x)}
    return out


def rewritten(text: Column, to: dict[str, str] | None = None) -> Column:
    """The words of text, in lower case and parted by a space, with the surfaces of rules, longer ones first, in the form they are rewritten to."""
    to = rules() if to is None else to
    surfaces = "|".join(sorted(to, key=lambda x: (-len(x), x)))
    marked = F.regexp_replace(F.array_join(tokens(text), " "), rf"(?<![^ ])({surfaces})(?![^ ])", "\u0001$1\u0002")
    forms = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    parts = F.split(marked, "\u0001")
    new = lambda p: F.concat(F.try_element_at(forms, F.split_part(p, F.lit("\u0002"), F.lit(1))), F.split_part(p, F.lit("\u0002"), F.lit(2)))
    return F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("\u0002")), new(p)).otherwise(p)), "")


def _deleted(word: Column) -> Column:
    """word, and what is left of it without one or two of its characters."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.transform(F.array(less(word)), lambda one: F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, less)))))[0]


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, word, distance): words within 0, 1 or 2 edits of a query's term, for up to 2, up to 5 and more characters (F6). terms may have their own bound, `most`.

    Two words within so many edits are alike without as many of their characters: so words meet by equality of what is left of them, and no word is
    compared with all others. Words longer than every term by more than 2 aren't looked at.
    """
    most = F.when(F.length("term") <= 2, 0).when(F.length("term") <= 5, 1).otherwise(2)
    t = terms.select("term", F.col("most") if "most" in terms.columns else most.alias("most")).distinct()
    longest = t.agg(F.max(F.length("term"))).first()[0] or 0
    v = vocabulary.select("word").distinct().where(F.length("word") <= longest + 2)
    left = lambda d, c: d.withColumn("left", F.explode(_deleted(F.col(c))))
    x = left(v, "word").join(near(left(t, "term")), "left").select("term", "word", "most").distinct()
    x = x.withColumn("distance", F.levenshtein("term", "word"))
    return x.where(F.col("distance") <= F.col("most")).groupBy("term", "word").agg(F.min("distance").alias("distance"))


def contexts(ranked: DataFrame, content: str = "content", metadata: str = "metadata", k: int = 3) -> DataFrame:
    """(q_id, contexts): of the first k results the contents, else the metadata; blanks are skipped after the cut."""
    text = F.coalesce(F.nullif(F.trim(content), F.lit("")), F.nullif(F.trim(metadata), F.lit("")))
    g = ranked.where(F.col("rank") <= k).groupBy("q_id").agg(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("rank", text.alias("text"))))).alias("c"))
    return g.select("q_id", F.col("c.text").alias("contexts"))


def normal_results(results: DataFrame, retriever: str) -> DataFrame:
    """(q_id, retriever, rank, doc_id, content, snippet): an image's metadata, else the content; 200 characters as the snippet."""
    text = F.coalesce(F.when(F.col("type") == "image", F.col("metadata")).otherwise(F.col("content")), F.lit(""))
    return results.select("q_id", F.lit(retriever).alias("retriever"), "rank", "doc_id", text.alias("content"), F.concat(F.substring(text, 1, 200), F.lit("...")).alias("snippet"))


def in_order(*results: DataFrame) -> DataFrame:
    """All results, those of the first retriever first: neither merged nor ranked anew."""
    x = None
    for i, r in enumerate(results):
        r = r.withColumn("retriever_rank", F.lit(i))
        x = r if x is None else x.unionByName(r)
    return x


def highlighted(text: Column, terms: Column) -> Column:
    """text with its words that are among terms (lower case) marked by <em>; null where there is none."""
    rx = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    new = F.when(F.size(terms) > 0, F.regexp_replace(text, rx, F.lit("<em>$1</em>")))
    return F.when(new != text, new)


def snippet(content: Column, metadata: Column, terms: Column, most: int = 200) -> Column:
    """The content with its matches marked, else the metadata with them, else the first characters of the content."""
    return F.coalesce(highlighted(content, terms), highlighted(metadata, terms), F.substring(content, 1, most))


#: What a stem is made of, for the rules of Porter's algorithm: y is a vowel after a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, ONE, MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
#: Porter's steps, each a list of (ending, what it becomes, what the stem before it must match, what it must not). The longest ending of a step counts.
PORTER = [
    [("sses", "ss", "", ""), ("ies", "i", "", ""), ("ss", "ss", "", ""), ("s", "", "", "")],
    [("eed", "ee", SOME, ""), ("ed", "\u0001", VOWEL, ""), ("ing", "\u0001", VOWEL, "")],
    [("at\u0001", "ate", "", ""), ("bl\u0001", "ble", "", ""), ("iz\u0001", "ize", "", "")] + [(f"{c}{c}\u0001", c, "", "") for c in "bcdfghjkmnpqrtvwxy"] + [("\u0001", "e", SHORT, "")],
    [("\u0001", "", "", "")],
    [("y", "i", VOWEL, "")],
    [(a, b, SOME, "") for a, b in [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]],
    [(a, b, SOME, "") for a, b in [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]],
    [(a, "", MORE, "") for a in ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]] + [("sion", "s", f"{MORE}|{_V}{_C}{_V}s?$", ""), ("tion", "t", f"{MORE}|{_V}{_C}{_V}t?$", "")],
    [("e", "", MORE, ""), ("e", "", ONE, SHORT)],
    [("ll", "l", f"{SOME}.*[aeiouy]$", "")],
]


_PLAIN = re.compile("[a-z]{3,}").fullmatch
_met = lambda rx: re.compile(rx).search if rx else None
#: PORTER by its endings: those of each step, longest first, and for each what it becomes and what the stem must and must not match.
_STEPS = [(tuple(sorted({e[0] for e in step}, key=lambda e: (-len(e), e))), {x: [(new, _met(must), _met(but)) for e, new, must, but in step if e == x] for x in {e[0] for e in step}}) for step in PORTER]


def stemmed(word: Column) -> Column:
    """The stem of a word in lower case by Porter's algorithm; words of up to two letters, and those of other characters than a to z, stay."""

    def step(w, endings):
        out = w
        for ending, new, must, but in sorted(endings, key=lambda e: len(e[0])):
            stem = F.substring(w, F.lit(1), F.length(w) - len(ending))
            met = F.lit(True) if not must else F.rlike(stem, F.lit(must))
            met = met & ~F.rlike(stem, F.lit(but)) if but else met
            # The longest ending decides, whether its stem fits or not; of equal endings, either may.
            other = out if [e for e in endings if e[0] == ending].index((ending, new, must, but)) else w
            out = F.when(w.endswith(ending), F.when(met, F.concat(stem, F.lit(new))).otherwise(other)).otherwise(out)
        return out

    plain = F.rlike(word, F.lit("^[a-z]{3,}$"))
    return F.when(plain, reduce(lambda w, endings: F.transform(w, lambda x: step(x, endings)), PORTER, F.array(word))[0]).otherwise(word)


def stem(word: str) -> str:
    """As stemmed, of a word at hand: the same steps of the same table."""
    if not _PLAIN(word):
        return word
    for some, endings in _STEPS:
        if word.endswith(some):
            ending = next(e for e in some if word.endswith(e))
            of = word[: len(word) - len(ending)]
            for new, must, but in endings[ending]:
                if (must is None or must(of)) and not (but and but(of)):
                    word = of + new
                    break
    return word


def terms_of(word: str) -> list[tuple[str, str]]:
    """(chain, term) of one word, as analysed gives them, repeats included."""
    pairs = [("ko", word[i : i + 2]) for i in range(max(len(word) - 1, 1))]
    return [("en", stem(word)), *pairs, *(("ngram", word[:n]) for n in (2, 3, 4) if n <= len(word))]


#: Terms of a row of the result of a count at most, and words whose terms a task remembers.
AT_MOST, REMEMBERED = 4096, 50_000


def _counted(batches):
    known = lru_cache(REMEMBERED)(terms_of)
    for batch in batches:
        keys, words = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            n: Counter = Counter()
            for w, times in Counter(words[i].values.to_pylist()).items():
                for t in known(w):
                    n[t] += times
            found = list(n.items())
            for at in range(0, len(found), AT_MOST):
                some = found[at : at + AT_MOST]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([i] * len(some))), pa.array([t[0] for t, _ in some]), pa.array([t[1] for t, _ in some]), pa.array([k for _, k in some], pa.int64())], ["k", "chain", "term", "n"])


def term_counts(texts: DataFrame) -> DataFrame:
    """(k, chain, term, n): how often each text (k, text) has each term of its chains (F2). Only texts are shuffled, to bring those of a key together; words and terms are counted in their row."""
    python_ready(texts.sparkSession)
    kind = next(f.dataType.simpleString() for f in texts.schema if f.name == "k")
    whole = texts.where("text is not null").groupBy("k").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return whole.select("k", tokens(F.col("text")).alias("ws")).mapInArrow(_counted, f"k {kind}, chain string, term string, n bigint")


def _spread(chain: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(chain).alias("chain"), t.alias("term")))


def _grams(words: Column) -> Column:
    """array of struct(chain, term): character pairs (ko) and edge n-grams of 2 to 4 (ngram) of words."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    edges = lambda w: F.transform(F.filter(F.array(*[F.lit(n) for n in (2, 3, 4)]), lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n))
    return F.concat(_spread("ko", F.flatten(F.transform(words, pairs))), _spread("ngram", F.flatten(F.transform(words, edges))))


def analysed(text: Column) -> Column:
    """array of struct(chain, term): stems of the words (en), character pairs of the words (ko), and edge n-grams of 2 to 4 (ngram) (F2)."""
    words = tokens(text)
    return F.concat(_spread("en", F.transform(words, stemmed)), _grams(words))


#: Weights of the fields by branch and chain, and how much fields count beside the best one.
WEIGHTS = {("content", "ko"): 2.5, ("content", "en"): 2.5, ("content", "ngram"): 0.5, ("metadata", "ko"): 1.5, ("metadata", "en"): 1.5}
TIE = {"content": 0.3, "metadata": 0.2}


#: Columns that the words of a field are dealt to, by their hash: a search reads those its terms may stand in.
COLUMNS = 16
#: Rows and bytes of words of a tile at most (a longer field is one of its own), its rows that are scored at once, and queries of a block.
TILE_ROWS, TILE_WORDS, SCORED, ASKED = 256, 1 << 20, 256, 256
#: Wanted terms in the words of some fields of a tile that are counted at once at most, unless one field has more.
EXPANDED = 1 << 18
#: Words a task remembers at most, to tell those it meets first.
MET = 500_000
#: Words up to which character pairs are cut by columns; longer ones one by one.
LONG = 40
BRANCHES, CHAINS = ("content", "metadata"), ("en", "ko", "ngram")


def column_of(word: Column) -> Column:
    """The number of the column that a word is dealt to."""
    return (F.crc32(word.cast("binary")) % COLUMNS).cast("int")


def _starts(lists: pa.Array) -> np.ndarray:
    """Where each list of an array begins among its values, and where the last ends."""
    return np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))])


def _split(texts: pa.Array) -> pa.Array:
    """Lists of the words of texts, which are parted by one space; null for none."""
    # not by if_else, which reads a slice of strings from the wrong place
    return pc.split_pattern(pc.replace_with_mask(texts, pc.equal(texts, "").fill_null(False), pa.scalar(None, pa.string())), " ")


def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


def _columns_of(words: pa.Array) -> np.ndarray:
    """As column_of, of many words at once: a byte of each at a time, those of over LONG bytes one by one."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data, begin, n = np.frombuffer(words.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)
    crc, table = np.full(len(words), 0xFFFFFFFF, np.uint32), _table()
    some = np.nonzero(n <= LONG)[0]
    for i in range(LONG):
        some = some[n[some] > i]
        if not len(some):
            break
        crc[some] = table[(crc[some] ^ data[begin[some] + i]) & 255] ^ (crc[some] >> 8)
    crc = ~crc
    for i in np.nonzero(n > LONG)[0]:
        crc[i] = crc32(data[begin[i] : begin[i] + n[i]].tobytes())
    return (crc % COLUMNS).astype(np.uint8)


class _Met:
    """The words a task has met, of which it forgets all when they are many."""

    def __init__(self):
        self.words = pa.array([], pa.string())

    def fresh(self, words: pa.Array, rows: int) -> pa.Array:
        """Those of distinct words that weren't met before, as one string in the first of so many rows."""
        new = words.filter(pc.invert(pc.is_in(words, value_set=self.words)))
        self.words = new if len(self.words) > MET else pa.concat_arrays([self.words, new])
        return pa.concat_arrays([pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new), " "), pa.nulls(rows - 1, pa.string())])


def let_go() -> None:
    """Give back to the system what this worker's allocators keep of what was freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def letting_go(run):
    """As run, of batches; a worker that is idle afterwards, or takes a task of another kind, keeps nothing of it."""

    def whole(batches):
        yield from run(batches)
        let_go()

    return whole


def _dealt_words(batches):
    met = _Met()
    for batch in batches:
        let_go()
        keys, branches, texts = batch.columns
        lists, rows = _split(texts), len(keys)
        if not rows:
            continue
        at, d = _starts(lists), lists.flatten().dictionary_encode()
        code = np.asarray(d.indices, np.int64)
        n = np.asarray(pc.utf8_length(d.dictionary), np.int64)[code]
        total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[at[1:]] - c[at[:-1]]
        content = np.asarray(pc.equal(branches, "content").fill_null(False))
        lens = np.stack([np.diff(at), total(np.maximum(n - 1, 1)), np.where(content, total(np.minimum(n - 1, 3)), 0)], axis=1)
        lens = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * 3, pa.int32()), pa.array(lens.ravel(), pa.int64()))
        to = _columns_of(d.dictionary)[code]
        many = np.bincount(to.astype(np.int64) * rows + np.repeat(np.arange(rows), np.diff(at)), minlength=COLUMNS * rows)
        by_column = d.dictionary.take(pa.array(code[np.argsort(to, kind="stable")]))
        parts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], many.cumsum()]), pa.int32()), by_column), " ")
        columns = [keys, branches, lens, *(parts.slice(c * rows, rows) for c in range(COLUMNS)), met.fresh(d.dictionary, rows)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "branch", "lens", *(f"w{c}" for c in range(COLUMNS)), "fresh"])


def _met_first(batches):
    met = _Met()
    for batch in batches:
        if batch.num_rows:
            words = pa.concat_arrays([_split(batch.column(f"w{c}")).flatten() for c in range(COLUMNS)]).unique()
            yield pa.RecordBatch.from_arrays([*batch.columns, met.fresh(words, batch.num_rows)], [*batch.schema.names, "fresh"])


def with_fresh(words: DataFrame) -> DataFrame:
    """Fields as `field_words` has them, that lack `fresh`."""
    python_ready(words.sparkSession)
    return words.mapInArrow(letting_go(_met_first), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", fresh string")


def field_words(chunks: DataFrame, key: str) -> DataFrame:
    """(key, branch, lens, w0, w1, .., fresh): the words of the one field each chunk is searched by, its content if it is text or a table, else its metadata, dealt to columns; how many terms its chains have. Words of a
    column are one string, parted by a space. fresh: the words a task met first in a batch, in one row of it, so that the vocabulary needs no look at all words.

    Only texts are shuffled, to deal them over all tasks and to bring together those of a key.
    """
    spark = chunks.sparkSession
    python_ready(spark)
    body = F.col("type").isin("text", "table")
    kind = next(f.dataType.simpleString() for f in chunks.schema if f.name == key)
    texts = chunks.select(F.col(key).alias("key"), F.when(body, "content").otherwise("metadata").alias("branch"), F.when(body, F.col("content")).otherwise(F.col("metadata")).alias("text"))
    whole = dealt(texts, "key").groupBy("key", "branch").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    columns = ", ".join(f"w{c} string" for c in range(COLUMNS))
    return whole.select("key", "branch", spaced(F.col("text")).alias("ws")).mapInArrow(letting_go(_dealt_words), f"key {kind}, branch string, lens array<bigint>, {columns}, fresh string")


def _stems(words: pa.Array) -> pa.Array:
    return pa.array([stem(w) for w in words.to_pylist()], pa.string())


def vocabulary(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(w, term): the distinct words of fields but those known (w), and the stem of each, worked out once."""
    python_ready(words.sparkSession)
    each = words.where("fresh <> ''").select(F.explode(F.split("fresh", " ")).alias("w")).distinct()
    if known is not None:
        each = each.join(known.select("w"), "w", "left_anti")
    return each.select("w", F.arrow_udf(_stems, "string")(F.col("w")).alias("term"))


def _asked(queries: DataFrame) -> DataFrame:
    """(q_id, chain, asked): the distinct terms of each query, after synonyms, by chain; edge n-grams are looked for by whole words."""
    q = queries.select("q_id", tokens(rewritten(F.col("query"))).alias("ws")).select("q_id", F.col("ws"))
    en = q.select("q_id", F.explode("ws").alias("w")).select("q_id", F.lit("en").alias("chain"), F.arrow_udf(_stems, "string")(F.col("w")).alias("asked"))
    ko = q.select("q_id", F.explode(_grams(F.col("ws"))).alias("a")).where("a.chain = 'ko'").select("q_id", F.lit("ko").alias("chain"), F.col("a.term").alias("asked"))
    whole = q.select("q_id", F.lit("ngram").alias("chain"), F.explode("ws").alias("asked"))
    return en.unionByName(ko).unionByName(whole).distinct()


class Source(NamedTuple):
    """What a keyword search reads: words(wanted: chain, term), fields as `field_words` has them, with the columns at least that wanted terms may stand in; stems(wanted: term), rows (w, term), which may be more than
    are wanted; near(asked, most). As `keyword_index` has them."""

    words: Callable[[DataFrame], DataFrame]
    stems: Callable[[DataFrame], DataFrame]
    near: Callable[[DataFrame], DataFrame]


def keyword_search(queries: DataFrame, chunks: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(q_id, key, score, rank): the top k of each query over weighted fields (F5), of chunks (key, type, content, metadata) that aren't indexed."""
    from sheaf.operators import keyword_index

    words = written(field_words(chunks, key))
    known = written(vocabulary(words))
    parts = keyword_index.parts_of(known.select("term").distinct())
    return ranked_fields(queries, Source(lambda _: words, lambda _: known, lambda asked: keyword_index.near_stems(asked, parts)), key, **how)


def _tiles(batches):
    """Fields of (key, branch, lens, ws) as rows of many: their keys, branches, lens and words, each as lists."""
    held, n, size = [], 0, 0

    def row():
        t = pa.Table.from_batches(held).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(i).combine_chunks()) for i in range(4)]
        return pa.RecordBatch.from_arrays(lists, ["keys", "branches", "lens", "ws"])

    for batch in batches:
        at, total = 0, np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column(3)).fill_null(0), np.int64))])
        while at < batch.num_rows:
            fits = int(np.searchsorted(total, total[at] + TILE_WORDS - size, side="right")) - 1 - at
            if n and fits < 1:
                yield row()
                held, n, size = [], 0, 0
                continue
            part = batch.slice(at, min(max(fits, 1), TILE_ROWS - n))
            held, n, at, size = [*held, part], n + part.num_rows, at + part.num_rows, size + int(total[at + part.num_rows] - total[at])
            if n >= TILE_ROWS or size >= TILE_WORDS:
                yield row()
                held, n, size = [], 0, 0
    if n:
        yield row()


def _as_bytes(kinds: list[str]):
    """Rows of a number and lists of structs, each list as the bytes of an Arrow stream, which go to tasks as they are."""

    def one(x: pa.Array) -> bytes:
        sink, x = pa.BufferOutputStream(), pa.RecordBatch.from_struct_array(x)
        with pa.ipc.new_stream(sink, x.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(x)
        return sink.getvalue().to_pybytes()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([one(batch.column(c)[i].values)], pa.binary()) for c in range(1, len(kinds)))], kinds)

    return run


def _structs(x: bytes) -> pa.Array:
    return pa.ipc.open_stream(x).read_all().to_struct_array().combine_chunks()


class _Block:
    """The wanted terms of a block of queries, by number: `terms` (chain, term) in the order they are first named."""

    def __init__(self, wanted: pa.Array):
        chain, term = wanted.field("chain"), wanted.field("term")
        d = pc.binary_join_element_wise(chain, term, "\u0000").dictionary_encode()
        self.of, self.terms = np.asarray(d.indices, np.int64), d.dictionary
        first = np.unique(self.of, return_index=True)[1]
        self.chain = np.asarray(pc.index_in(chain, value_set=pa.array(CHAINS)), np.int64)[first]
        self.texts = term.take(pa.array(first))
        self.numbers = {c: np.nonzero(self.chain == j)[0] for j, c in enumerate(CHAINS)}


def _pairs_of(words: pa.Array, size: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, term) of all character pairs of words that are known, by number, repeats included."""
    ws, ts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    short = np.nonzero(size <= LONG)[0]
    for i in range(LONG):
        some = short if i == 0 else short[size[short] >= i + 2]
        if not len(some):
            break
        short = some
        found = pc.index_in(pc.utf8_slice_codeunits(words.take(pa.array(some)), i, i + 2), value_set=known)
        has = np.asarray(found.is_valid())
        ws.append(some[has])
        ts.append(np.asarray(found.drop_null(), np.int64))
    numbers = {t: i for i, t in enumerate(known.to_pylist())}
    for i in np.nonzero(size > LONG)[0]:
        w = words[int(i)].as_py()
        t = [numbers[p] for j in range(len(w) - 1) if (p := w[j : j + 2]) in numbers]
        ws.append(np.full(len(t), i, np.int64))
        ts.append(np.array(t, np.int64))
    return np.concatenate(ws), np.concatenate(ts)


def _summed(row: np.ndarray, col: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, n), n summed by row and col, in their order."""
    if not len(row):
        return row, col, np.empty(0, np.int64)
    bits = int(n.max()).bit_length()
    both = row * width
    both += col
    both <<= bits
    both |= n.astype(np.int64)
    both.sort()  # counts ride in the low bits: a plain sort is several times faster than one that tells where each came from
    at = both >> bits
    both &= (1 << bits) - 1
    first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
    at, n = at[first], np.add.reduceat(both, first)
    row = at // width
    return row, at - row * width, n


def _spans(begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begins, begins + 1, .., as many as counted, one span after the other."""
    return np.repeat(begins, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _expanded(row: np.ndarray, code: np.ndarray, times: np.ndarray, first: np.ndarray, t: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, n): words of fields (row, word, times, in order of rows) by their terms, those of a word from first[word] on, summed. Some fields at a time, so that what is held doesn't grow with a tile."""
    got = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    many = first[code + 1] - first[code] if len(code) else np.empty(0, np.int64)
    total, at = np.cumsum(many), 0
    while at < len(row):
        last = row[min(int(np.searchsorted(total, (total[at - 1] if at else 0) + EXPANDED, side="right")), len(row) - 1)]
        # fields before the one in which it is too many, or this one alone
        end = int(np.searchsorted(row, last, side="left" if last > row[at] and total[-1] > (total[at - 1] if at else 0) + EXPANDED else "right"))
        each, some = many[at:end], slice(at, end)
        to = _spans(first[code[some]], each)
        x = _summed(np.repeat(row[some], each), t[to], np.repeat(times[some], each) * n[to], width)
        got.append(tuple(c.astype(np.int64) for c in x))
        at = end
    return tuple(np.concatenate(c) for c in zip(*got, strict=True))


def _wanted_in(block: int, held: tuple, keys: pa.Array, branches: pa.Array, lens: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The counts of a block's wanted terms in the fields of a tile."""
    b, forms, form_of = held
    lists, width = _split(texts), max(len(b.texts), 1)
    at, flat = _starts(lists), lists.flatten()
    d = flat.dictionary_encode()
    words, many = d.dictionary, max(len(d.dictionary), 1)
    size = np.asarray(pc.utf8_length(words), np.int64)
    number = lambda chain, t: b.numbers[chain][t]
    hit = pc.index_in(words, value_set=forms)
    ws, ts = [np.nonzero(np.asarray(hit.is_valid()))[0]], [number("en", form_of[np.asarray(hit.drop_null(), np.int64)])]
    if len(b.numbers["ko"]):
        w, t = _pairs_of(words, size, b.texts.take(pa.array(b.numbers["ko"])))
        ws, ts = [*ws, w], [*ts, number("ko", t)]
    if len(b.numbers["ngram"]):
        edges = b.texts.take(pa.array(b.numbers["ngram"]))
        for n in (2, 3, 4):
            some = np.nonzero(size >= n)[0]
            hit = pc.index_in(pc.utf8_slice_codeunits(words.take(pa.array(some)), 0, n), value_set=edges)
            ws, ts = [*ws, some[np.asarray(hit.is_valid())]], [*ts, number("ngram", np.asarray(hit.drop_null(), np.int64))]
    w, t, n = _summed(np.concatenate(ws), np.concatenate(ts), np.ones(sum(map(len, ws))), width)
    first = np.searchsorted(w, np.arange(many + 1))
    row, code, times = _summed(np.repeat(np.arange(len(keys)), np.diff(at)), np.asarray(d.indices, np.int64), np.ones(len(flat)), many)
    row, term, n = _expanded(row, code, times, first, t, n, width)
    edge = ~np.asarray(pc.equal(branches, "content")) if len(keys) else np.empty(0, bool)
    keep = ~(edge[row] & (b.chain[term] == CHAINS.index("ngram"))) if len(row) else np.empty(0, bool)
    row, term, n = row[keep], term[keep], n[keep]
    ends = np.searchsorted(row, np.arange(len(keys)), side="right")
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *map(one, (keys, branches, lens)), one(pa.array(ends, pa.int32())), one(pa.array(term, pa.int32())), one(pa.array(n, pa.int32()))],
                                      ["block", "keys", "branches", "lens", "ends", "terms", "ns"])


def _found(sent):
    """Of tiles (keys, branches, lens, ws), the counts of the wanted terms of each block (block, wanted, forms) in each field: (block, keys, branches, lens, ends, terms, ns)."""

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            for block, wanted, forms in sent.value:
                if block not in known:
                    known.clear()
                    b, f = _Block(_structs(wanted)), _structs(forms)
                    known[block] = b, f.field("w"), np.asarray(pc.index_in(f.field("term"), value_set=b.texts.take(pa.array(b.numbers["en"]))), np.int64)
                    del b, f
                for i in range(batch.num_rows):
                    let_go()
                    yield _wanted_in(block, known[block], *(batch.column(c)[i].values for c in range(4)))

    return letting_go(run)


def _in_fields(batches):
    """(block, branch, term, df) of tiles: in how many fields of a branch a term stands, summed over a task."""
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            block, branches, ends, terms = batch.column(0)[i].as_py(), *(batch.column(c)[i].values for c in (1, 2, 3))
            row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], np.asarray(ends, np.int64)])))
            content, terms = np.asarray(pc.equal(branches, "content"))[row], np.asarray(terms, np.int64)
            for branch, mine in zip(BRANCHES, (content, ~content), strict=True):
                n = np.bincount(terms[mine]) if mine.any() else np.empty(0, np.int64)
                old = held.get((block, branch), np.empty(0, np.int64))
                both = np.zeros(max(len(old), len(n)), np.int64)
                both[: len(old)] += old
                both[: len(n)] += n
                held[block, branch] = both
    for (block, branch), n in held.items():
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array([branch] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["block", "branch", "term", "df"])


def _scored(k: int, least: int, k1: float, b1: float, sent):
    """Of tiles of counts, whose blocks are (wanted, dfs, stats) by their number, (q_id, key, raw) that may be among the k best of a query: those within a margin of the k-th of a tile; of equal scores the k smallest keys."""

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                keys, branches, lens, ends, terms, ns = (batch.column(c)[i].values for c in range(1, 7))
                block = batch.column(0)[i].as_py()
                if block not in sent.value:
                    continue
                if block not in known:
                    known.clear()
                    let_go()
                    wanted, dfs, stats = map(_structs, sent.value[block])
                    b = _Block(wanted)
                    qs = wanted.field("q_id").dictionary_encode()
                    asks = wanted.field("asked").dictionary_encode()
                    idf = {}
                    many = {(s["branch"], c): (s["ns"][j], s["lens"][j]) for s in stats.to_pylist() for j, c in enumerate(CHAINS)}
                    df = {x: np.zeros(len(b.texts)) for x in BRANCHES}
                    for x in BRANCHES:
                        mine = np.asarray(pc.equal(dfs.field("branch"), x))
                        df[x][np.asarray(dfs.field("term"), np.int64)[mine]] = np.asarray(dfs.field("df"), np.float64)[mine]
                        n = np.array([many.get((x, c), (0, 0))[0] for c in CHAINS], np.float64)[b.chain]
                        idf[x] = np.log(1 + (np.maximum(n - df[x], 0) + 0.5) / (df[x] + 0.5))
                    of = np.argsort(b.of, kind="stable")  # the rows of wanted by term, and where those of each begin
                    known[block] = b, qs.dictionary, np.asarray(qs.indices, np.int64), np.asarray(asks.indices, np.int64), len(asks.dictionary), np.asarray(wanted.field("right"), np.float64), idf, many, of, np.searchsorted(b.of[of], np.arange(len(b.texts) + 1))
                b, q_ids, q_of, ask_of, n_asks, right, idf, many, of, first = known[block]
                n_q, size = len(q_ids), np.asarray(lens.flatten(), np.float64).reshape(-1, 3)
                ends, terms, ns = (np.asarray(x, np.int64) for x in (ends, terms, ns))
                begins = np.concatenate([[0], ends[:-1]])
                branch = np.where(np.asarray(pc.equal(branches, "content")), BRANCHES[0], BRANCHES[1])
                fine = np.asarray(keys.is_valid())
                got = []
                for x in BRANCHES:
                    rows = np.nonzero((branch == x) & fine)[0]
                    for at in range(0, len(rows), SCORED):
                        some = rows[at : at + SCORED]
                        count = ends[some] - begins[some]
                        r, src = np.repeat(np.arange(len(some)), count), _spans(begins[some], count)
                        t, n = terms[src], ns[src].astype(np.float64)
                        best, all_, words = np.zeros((len(some), n_q)), np.zeros((len(some), n_q)), np.zeros((len(some), n_q), np.int64)
                        for j, c in enumerate(CHAINS):
                            weight, (_, mean) = WEIGHTS.get((x, c)), many.get((x, c), (0, None))
                            mine = b.chain[t] == j
                            if weight is None or not mine.any():
                                continue
                            rr, tt, nn = r[mine], t[mine], n[mine]
                            part = idf[x][tt] * nn * (k1 + 1) / (nn + k1 * (1 - b1 + b1 * size[some, j][rr] / mean))
                            if c == "ko":  # pairs are few and stand in most fields
                                place = np.full(len(b.texts), -1)
                                place[tt] = 0
                                here = np.nonzero(place == 0)[0]
                                place[here] = np.arange(len(here))
                                have = np.zeros((len(some), len(here)))
                                have[rr, place[tt]] = part
                                use = of[_spans(first[here], first[here + 1] - first[here])]
                                give = np.zeros((len(here), n_q))
                                np.add.at(give, (place[b.of[use]], q_of[use]), right[use])
                                s = weight * (have @ give)
                            else:  # stems near a query's are many, and few of them stand in one field
                                each = first[tt + 1] - first[tt]
                                use, at_row = of[_spans(first[tt], each)], np.repeat(rr, each)
                                s = weight * np.bincount(at_row * n_q + q_of[use], weights=np.repeat(part, each) * right[use], minlength=len(some) * n_q).reshape(len(some), n_q)
                                if c == "en" and least > 1:
                                    met = np.unique((at_row * n_q + q_of[use]) * n_asks + ask_of[use])
                                    words += np.bincount(met // n_asks, minlength=len(some) * n_q).reshape(len(some), n_q)
                            best, all_ = np.maximum(best, s), all_ + s
                        s = np.where((best > 0) & ((words >= least) | (least <= 1)), best + TIE[x] * (all_ - best), -np.inf)
                        got.append((some, s))
                if not got:
                    continue
                rows, s = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                order = np.empty(len(keys), np.int64)
                order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                least_s = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(n_q, -np.inf)
                at_q, at_r = np.nonzero((s >= least_s[None, :] - 2e-6).T & (s > -np.inf).T)
                raw = s[at_r, at_q]
                by = np.lexsort((order[rows[at_r]], -raw, at_q))
                at_q, at_r, raw = at_q[by], at_r[by], raw[by]
                if not len(raw):
                    continue
                new = np.r_[True, (np.diff(at_q) != 0) | (np.diff(raw) != 0)]
                keep = np.arange(len(raw)) - np.maximum.accumulate(np.where(new, np.arange(len(raw)), 0)) < k
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at_q[keep])), keys.take(pa.array(rows[at_r[keep]])), pa.array(raw[keep])], ["q_id", "key", "raw"])

    return letting_go(run)


def ranked_fields(queries: DataFrame, source: Source, key: str = "doc_id", k: int = 10, least_terms: int = 1, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q_id, key, score, rank): the top k of each query (q_id, query) over weighted fields.

    Texts and tables are scored by their content, other chunks by their metadata. Each chain of a field gives a BM25 score times its weight; the best counts whole, the others by the
    tie. Terms of the en chain are looked for with typing errors too (F6; one edit for queries of up to three characters), each by what share of it is right. A chunk must hold
    at least so many of the query's words, in the en chain.

    Fields go in tiles, queries in blocks; a tile meets each block, which tasks are sent once, for its counts of wanted terms, and, once it is known in how many fields each term stands, as matrices for its scores. Nothing is shuffled
    but what may be among the best of a tile.
    """
    spark = queries.sparkSession
    python_ready(spark)
    asked = written(_asked(queries))
    short = queries.where(F.length("query") <= 3).select("q_id", F.lit(1).alias("one"))
    en = asked.where("chain = 'en'").join(near(short), "q_id", "left").select("asked", F.coalesce("one", F.when(F.length("asked") <= 2, 0).when(F.length("asked") <= 5, 1).otherwise(2)).alias("most")).distinct()
    like = source.near(en).groupBy("asked", "term").agg(F.min("distance").alias("distance"))
    like = like.select("asked", "term", (1 - F.col("distance") / F.least(F.length("asked"), F.length("term"))).alias("right"))
    wanted = asked.where("chain <> 'en'").select("q_id", "chain", "asked", F.col("asked").alias("term"), F.lit(1.0).alias("right"))
    wanted = wanted.unionByName(asked.where("chain = 'en'").join(like, "asked").where("right > 0").select("q_id", "chain", "asked", "term", "right"))
    n_blocks = max(1, -(-queries.select("q_id").distinct().count() // ASKED))
    wanted = written(wanted.where("q_id is not null").withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(n_blocks))))
    stems = wanted.where("chain = 'en'").select("block", "term").distinct()
    forms = source.stems(stems.select("term").distinct()).select("w", "term").distinct().join(near(stems), "term").groupBy("block").agg(F.collect_list(F.struct("w", "term")).alias("forms"))
    none = F.array().cast("array<struct<w:string,term:string>>")
    blocks = wanted.groupBy("block").agg(F.collect_list(F.struct("q_id", "chain", "asked", "term", "right")).alias("wanted"))
    blocks = blocks.join(forms, "block", "left").select("block", "wanted", F.coalesce("forms", none).alias("forms"))
    blocks = written(blocks.mapInArrow(_as_bytes(blocks.columns), "block bigint, wanted binary, forms binary"))
    words = source.words(wanted)
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    columns = [c for c in kinds if re.fullmatch(r"w\d+", c)]
    stat = lambda f: F.array(*[f(F.get("lens", F.lit(j))) for j in range(3)])
    stats = words.groupBy("branch").agg(stat(lambda c: F.count_if(c > 0)).alias("ns"), stat(lambda c: F.avg(F.when(c > 0, c))).alias("lens")).agg(F.collect_list(F.struct("branch", "ns", "lens")).alias("stats"))
    tiles = words.select("key", "branch", "lens", F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns]).alias("ws")).mapInArrow(letting_go(_tiles), f"keys array<{kinds['key']}>, branches array<string>, lens array<array<bigint>>, ws array<string>")
    sent = spark.sparkContext.broadcast([(r.block, bytes(r.wanted), bytes(r.forms)) for r in blocks.collect()])  # as bytes, compressed; once to each executor, not with every tile
    found = written(tiles.mapInArrow(_found(sent), f"block bigint, keys array<{kinds['key']}>, branches array<string>, lens array<array<bigint>>, ends array<int>, terms array<int>, ns array<int>"))
    df = found.select("block", "branches", "ends", "terms").mapInArrow(letting_go(_in_fields), "block bigint, branch string, term int, df bigint").groupBy("block", "branch", "term").agg(F.sum("df").alias("df"))
    df = df.groupBy("block").agg(F.collect_list(F.struct("branch", "term", "df")).alias("dfs")).crossJoin(F.broadcast(stats)).select("block", "dfs", "stats")
    known = written(blocks.select("block", "wanted").join(df.mapInArrow(_as_bytes(df.columns), "block bigint, dfs binary, stats binary"), "block"))
    sent = spark.sparkContext.broadcast({r.block: (bytes(r.wanted), bytes(r.dfs), bytes(r.stats)) for r in known.collect()})
    q_kind = next(f.dataType.simpleString() for f in queries.schema if f.name == "q_id")
    s = found.mapInArrow(_scored(k, least_terms, k1, b, sent), f"q_id {q_kind}, key {kinds['key']}, raw double").select("q_id", F.col("key").alias(key), F.round("raw", 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def by_embedding(queries: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", k: int = 50) -> DataFrame:
    """(q_id, key, cosine, rank): the k chunks of each query whose vectors (F10) are nearest; chunks that share no dimension with it aren't ranked."""
    unit = F.transform("n", lambda n: n / F.sqrt(F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x * x).cast("double")))
    dense = lambda df, of, what: _dims(df, of, what, 64).select(of, unit.alias("v"))
    q, c = dense(queries, "q_id", "query").withColumnRenamed("v", "qv"), written(dense(chunks, key, text))
    c = candidates(q, c, key, "v", None, k, "dot").select("q_id", F.col("key").alias(key), F.round("raw", 6).alias("cosine"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("cosine"), key))).where(F.col("rank") <= k)


def _hashed(dims: int):
    def run(batches):
        for batch in batches:
            keys, lists = batch.columns
            d, rows = lists.flatten().dictionary_encode(), np.repeat(np.arange(len(keys)), np.diff(_starts(lists)))
            to = np.array([int(md5(w.encode()).hexdigest()[:6], 16) % dims for w in d.dictionary.to_pylist()], np.int64)
            n = np.bincount(rows * dims + to[np.asarray(d.indices, np.int64)], minlength=len(keys) * dims) if len(rows) else np.zeros(len(keys) * dims, np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * dims, pa.int32()), pa.array(n, pa.int64()))], ["k", "n"])

    return run


def _dims(chunks: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, n): how many words of a text have each hash, counted in its row; texts without words have no rows. Only texts are shuffled, to bring those of a key together."""
    python_ready(chunks.sparkSession)
    kind = next(f.dataType.simpleString() for f in chunks.schema if f.name == key)
    whole = dealt(chunks.select(F.col(key).alias("k"), F.col(text).alias("t")), "k").groupBy("k").agg(F.array_join(F.collect_list("t"), "\n").alias("t"))
    some = whole.select("k", tokens(F.col("t")).alias("ws")).where(F.size("ws") > 0)
    return some.mapInArrow(_hashed(dims), f"k {kind}, n array<bigint>").withColumnRenamed("k", key)


def embed(chunks: DataFrame, key: str = "doc_id", text: str = "text", dims: int = 64) -> DataFrame:
    """(key, dim, weight): unit vectors in sparse form, words counted by a hash of theirs modulo dims.

    The place where a trained model's vectors would come in; these need no model. Texts without words have no rows.
    """
    norm = F.sqrt(F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x * x).cast("double"))
    n = _dims(chunks, key, text, dims).select(key, norm.alias("norm"), F.posexplode("n").alias("dim", "n"))
    return n.where("n > 0").select(key, "dim", (F.col("n") / F.col("norm")).alias("weight"))


def _unit(df: DataFrame, vector: str) -> DataFrame:
    """df with `_unit`: its vectors at length 1, so that Euclidean neighbours are those by cosine; rows with a null vector, null components or none at all left out."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    v = F.col(vector).cast("array<double>")
    fine = df.where(F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))
    return Normalizer(inputCol="_raw", outputCol="_unit").transform(fine.withColumn("_raw", array_to_vector(v))).drop("_raw")


def vector_index(vectors: DataFrame, at: str, key: str = "vec_id", vector: str = "embedding", lists: int = 64, sample: int = 100_000, seed: int = 7) -> None:
    """An index of all vectors in the folder `at`: lists, one for each of so many k-means centroids, and the centroids.

    Centroids are learnt from about `sample` rows, drawn by the hash of their key; every vector goes to the list of the nearest.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    x = _unit(vectors.select(key, F.col(vector).alias("v")), "v")
    n = x.count()
    some = x if n <= sample else x.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    if not n:
        centres = vectors.sparkSession.createDataFrame([], "list int, centre array<double>")
        x.select(key, "v").write.mode("overwrite").parquet(f"{at}/lists/list=0")
    else:
        model = KMeans(featuresCol="_unit", predictionCol="list", k=max(2, min(lists, n)), seed=seed, maxIter=20).fit(some)
        centres = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
        model.transform(x).select(key, vector_to_array("_unit").alias("v"), "list").hint("rebalance", "list").write.partitionBy("list").mode("overwrite").parquet(f"{at}/lists")
    centres.coalesce(1).write.mode("overwrite").parquet(f"{at}/centres")


def near_neighbours(queries: DataFrame, at: str, key: str = "vec_id", k: int = 5, probes: int = 8) -> DataFrame:
    """(q_id, key, score, rank): the k nearest by cosine among the vectors of the lists whose centroids are nearest to each query (q_id, qv), ranked exactly.

    Only lists that some query probes are read. Queries are a stated set; tiles of a list meet blocks of its queries as matrices (`candidates`).
    """
    from pyspark.ml.functions import vector_to_array

    spark = queries.sparkSession
    q = _unit(queries.select("q_id", "qv"), "qv").select("q_id", vector_to_array("_unit").alias("qv"))
    centres = spark.read.parquet(f"{at}/centres").agg(F.array_sort(F.collect_list(F.struct("list", "centre"))).alias("centres"))  # a bounded number of centroids
    far = lambda c: F.aggregate(F.zip_with("qv", c.centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_sort(F.transform("centres", lambda c: F.struct(far(c).alias("far"), c["list"].alias("list"))))
    probed = dealt(q, "q_id").crossJoin(F.broadcast(centres)).select("q_id", "qv", F.explode(F.slice(nearest, 1, probes).list).alias("list"))
    probed = written(probed.repartition("list").sortWithinPartitions("list"))
    read = [r["list"] for r in probed.select("list").distinct().collect()]  # as many as there are lists at most
    x = spark.read.parquet(f"{at}/lists").where(F.col("list").isin(read))
    x = candidates(probed, x, key, "v", None, k, "inner", "list").select("q_id", F.col("key").alias(key), F.round("raw", 6).alias("score"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
