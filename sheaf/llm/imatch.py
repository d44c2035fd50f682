"""Document fingerprints by I-Match, in DataFrame operations only.

The lexicon is every term whose inverse document frequency, over the whole table, lies in a band. A document keeps its distinct terms
of the lexicon, sorted by their hashes. Each of 60 randomised subsets of the lexicon gives a digest: the hash of the kept terms that it holds, in this order. Subsets
are of five sizes, so that for short and for long documents some hold one or a few terms. A document that has no term in any
subset has the hash of all its terms for every digest; one without terms has zeros.

The lower bound of the band also bounds the lexicon: with d distinct terms in a document on average, at most d / least_share terms
occur in a share least_share of documents, however many these are. It is broadcast if it has no more rows than max_broadcast, and joined by a
shuffle otherwise. What a document keeps is gathered in its own row, and is no more than its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheaf.llm.common import table
from sheaf.llm.licenses import words
from sheaf.session import discard, written

#: One in so many terms is in a subset; twelve subsets of each size.
RATES = (32, 64, 128, 256, 512)
SEEDS = 12
SUBSETS = [(rate, seed) for rate in RATES for seed in range(SEEDS)]


def terms(text: Column) -> Column:
    return F.array_distinct(words(text))


def lexicon(docs: DataFrame, text: str = "text", least_share: float = 0.002, most_share: float = 0.2) -> DataFrame:
    """(hash, df, idf, subsets): the 64-bit hashes of the terms in least_share to most_share of the documents (and in two at least), and the subsets each is in."""
    n = docs.count()
    low, high = max(2, math.ceil(least_share * n)), max(2, math.floor(most_share * n))
    df = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy(F.xxhash64("term").alias("hash")).agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    within = [F.when(F.pmod(F.xxhash64("hash", F.lit(rate), F.lit(seed)), F.lit(rate)) == 0, F.lit(k)) for k, (rate, seed) in enumerate(SUBSETS)]
    return df.select("hash", "df", F.log(F.lit(float(n)) / F.col("df")).alias("idf"), F.array_compact(F.array(*within)).alias("subsets"))


#: Stands for a null key, which is smaller than any other.
NO_KEY = str(-(1 << 63) - 1)


def keyed(column: Column) -> Column:
    """An integer key as a decimal that is never null, in the same order, nulls first: so that rows with a null key join and sort like others."""
    return F.coalesce(column.cast("decimal(20,0)"), F.lit(NO_KEY).cast("decimal(20,0)"))


def unkeyed(k: Column) -> Column:
    return F.when(k > F.lit(NO_KEY).cast("decimal(20,0)"), k.cast("bigint"))


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k: the key as by `keyed`, text_id, text, copies): the distinct texts of each key, a hash of each, and how many rows hold it.

    Rows are shuffled by key and hash, which later joins on both reuse.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(keyed(F.col(key)).alias("k"), _text_id(given).alias("text_id"), given.alias("text")).repartition("k", "text_id")
    return rows.groupBy("k", "text_id", "text").agg(F.count("*").alias("copies"))


def _text_id(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def repeated(rows: DataFrame, copies: Column) -> DataFrame:
    """rows, each as often as copies says."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).drop("_copy")


def _folded(kept: Column, whole: Column) -> Column:
    """The digests from the kept terms, sorted structs of (subset, hash): one fold, in which a term is hashed onto its subset's digest so far."""
    digest = lambda h: F.shiftright(h, 32).cast("int")
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    begin = F.struct(F.lit(-1).alias("subset"), F.lit(0).cast("bigint").alias("h"), F.array().cast("array<int>").alias("out"))
    closed = lambda s: F.concat(s["out"], F.array(digest(s["h"])))

    def step(s, x):
        return F.when(s["subset"] == x["subset"], F.struct(s["subset"].alias("subset"), F.xxhash64(s["h"], x["hash"]).alias("h"), s["out"].alias("out"))).otherwise(
            F.struct(x["subset"].alias("subset"), F.xxhash64(F.lit(0).cast("bigint"), x["hash"]).alias("h"), F.when(s["subset"] < 0, zeros(x["subset"])).otherwise(F.concat(closed(s), zeros(x["subset"] - s["subset"] - 1))).alias("out")))

    bare = F.array_repeat(F.coalesce(digest(whole), F.lit(0)), len(SUBSETS))
    return F.aggregate(kept, begin, step, lambda s: F.when(s["subset"] < 0, bare).otherwise(F.concat(closed(s), zeros(F.lit(len(SUBSETS) - 1) - s["subset"]))))


def digests(rows: DataFrame, keys: list[str], lex: DataFrame, max_broadcast: int = 300_000) -> DataFrame:
    """keys and `digests`, an integer for each subset (0: it holds no term), for each combination of keys in rows (keys, text)."""
    # The empty term stands in every text, under no subset, so that no text is lost.
    none = lex.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("hash"), F.lit(None).cast("int").alias("subset"))
    known = lex.select("hash", F.explode("subsets").alias("subset")).union(none)
    known = F.broadcast(known) if lex.count() <= max_broadcast else known
    own = rows.select(*keys, terms(F.col("text")).alias("ts"))
    own = own.withColumn("whole", F.when(F.size("ts") > 0, F.xxhash64("ts")))  # before the terms are spread, or it would be worked out for each
    own = own.select(*keys, "whole", F.explode(F.concat(F.array(F.lit("")), "ts")).alias("term"))
    met = own.select(*keys, "whole", F.xxhash64("term").alias("hash")).join(known, "hash")
    kept = met.groupBy(*keys).agg(F.max("whole").alias("whole"), F.array_sort(F.collect_set(F.when(F.col("subset").isNotNull(), F.struct("subset", "hash")))).alias("kept"))
    return kept.select(*keys, _folded(F.col("kept"), F.col("whole")).alias("digests"))


def hexed(digests: Column) -> Column:
    """Digests as one string, 8 hex digits each."""
    return F.array_join(F.transform(digests, lambda x: F.substring(F.lpad(F.hex(x.cast("bigint")), 16, "0"), 9, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal digests among the subsets that hold a term of either; 1 where both have no digest at all, as two texts without terms."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))
    some, same = F.size(F.filter(pairs, lambda x: x > 0)), F.size(F.filter(pairs, lambda x: x == 2))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", **band: float) -> DataFrame:
    """(key, fingerprint: 8 hex digits for each subset) for each row of docs; keys are integers.

    Null and empty texts, and those without terms, have a fingerprint of zeros; equal texts have equal ones, however often they are repeated and under whatever key, null
    ones too. Texts are read whole. Terms are hashed in the order of their hashes, so ties don't arise; other columns aren't read; an empty table gives no rows.
    """
    found = digests(distinct_texts(docs, key, text), ["k", "text_id", "copies"], lexicon(docs, text, **band))
    return repeated(found, F.col("copies")).select(unkeyed(F.col("k")).alias(key), hexed(F.col("digests")).alias("fingerprint"))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, text_id, n_chars, next_id, next_text, user_id, user_text, user_chars) of each distinct pair of a key and a text: the next smaller pair (after the smallest: the largest; null is the
    smallest key; of a key's texts, the order is that of their hashes), and the pair whose next this is; keys as by `keyed`.

    Pairs are sorted in range partitions; only the ends of these, a row each, meet in one task.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(keyed(F.col(key)).alias("k"), _text_id(given).alias("t"), F.length(given).cast("bigint").alias("n")).distinct()
    ids = written(ids.repartitionByRange("k", "t").withColumn("part", F.spark_partition_id()))
    pair = F.struct("k", "t", "n")
    ends = ids.groupBy("part").agg(F.max(pair).alias("top"), F.min(pair).alias("low"))
    every = W.orderBy("part")
    wrap = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lag("top").over(every), F.last("top").over(wrap)).alias("below"),
        F.coalesce(F.lead("low").over(every), F.first("low").over(wrap)).alias("above"),
    )
    inside = W.partitionBy("part").orderBy("k", "t")
    x = ids.join(F.broadcast(ends), "part").select("k", "t", "n", F.coalesce(F.lag(pair).over(inside), "below").alias("next"), F.coalesce(F.lead(pair).over(inside), "above").alias("user"))
    return x.select("k", F.col("t").alias("text_id"), F.col("n").alias("n_chars"), F.col("next.k").alias("next_id"), F.col("next.t").alias("next_text"), F.col("user.k").alias("user_id"), F.col("user.t").alias("user_text"), F.col("user.n").alias("user_chars"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    A row for each row. Where an id has several texts, each is a document, in the order of their hashes; rows that repeat id and text are one document, and have equal results. A null id is the smallest.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = written(lexicon(docs))
    ids = written(neighbours(docs))
    base = distinct_texts(docs, "doc_id", "text").join(ids, ["k", "text_id"])
    given = base.select(F.col("user_id").alias("k"), F.col("user_text").alias("text_id"), F.expr("substring(text, 1, cast(user_chars div 2 as int))").alias("given"))
    own = ["k", "text_id", "n_chars", "next_id", "next_text", "copies"]
    both = base.join(given, ["k", "text_id"]).select(*own, "text", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), given)").alias("edited"))
    keys = [*own, "edited_sha256", "edited"]
    rows = both.select(*own, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(False).alias("edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("edited"), F.col("edited").alias("text")))).alias("e"))
    rows = rows.select(*own, "edited_sha256", "e.edited", "e.text")
    pick = lambda edited: F.max(F.when(F.col("edited") == edited, F.col("digests")))
    found = written(digests(rows, keys, lex).groupBy(*keys[:-1]).agg(pick(False).alias("own"), pick(True).alias("changed")))
    discard(lex, ids)
    after = found.groupBy(F.col("k").alias("next_id"), F.col("text_id").alias("next_text")).agg(F.max("own").alias("after"))
    return repeated(found.join(after, ["next_id", "next_text"]), F.col("copies")).select(
        unkeyed(F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
