"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are two parts, of 33 and of 31 bits. Of up to 4 differing bits, at most 1 falls in the first
part or at most 2 in the second. The anchors of a part are the words of a covering code: the Hamming code on 31 bits,
of radius 1 (the two bits left over in the first part are coded as they are). A fingerprint's home is its nearest anchor, at most 1
away; so another that differs in up to t bits of the part lies within 1 + t of that anchor. Each fingerprint is copied
to every anchor within 1 + t, which the syndrome of the code lists, and compared with those at home there.
Only distinct fingerprints are compared. With 2^28 and 2^26 anchors, the copies of a fingerprint meet few strangers.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import python_ready, table, unused
from sheaf.operators.components import connected_components
from sheaf.session import written

THRESHOLD = 4
#: name, shift, bits, of which coded by the Hamming code, bits that may differ
PARTS = [("a", 31, 33, 31, 1), ("b", 0, 31, 31, 2)]
RADIUS = 1


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of a text: its word shingles hashed by XXH64 (seed 42), each bit by majority; 0 for no words."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    s, h = b" ".join(w), xxhash.xxh64_intdigest
    n = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(n + 1) - 1
    if len(w) <= words:
        hashes = [h(s, 42)]
    else:
        hashes = [h(s[i:j], 42) for i, j in zip((end - n)[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)]
    total, k = np.zeros(64, np.int64), len(hashes)
    for i in range(0, k, 65536):
        bits = np.unpackbits(np.array(hashes[i : i + 65536], ">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > k).tobytes(), "big", signed=True)


def _fingerprints(words):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py() or "", words) for x in texts], pa.int64())

    return run


def fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash", words: int = 4) -> DataFrame:
    """docs with a column `out`: the SimHash of the whole text as a bigint (0 for null and empty texts)."""
    python_ready(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(_fingerprints(words), "bigint")(F.col(text)))


def patterns(bits: int, coded: int, reach: int) -> list[list[int]]:
    """For each syndrome of the Hamming code, the bit patterns of up to `reach` bits that lead from a word to an anchor."""
    out: list[list[int]] = [[] for _ in range(coded + 1)]
    for k in range(reach + 1):
        for at in combinations(range(bits), k):
            syndrome = reduce(lambda x, i: x ^ (i + 1 if i < coded else 0), at, 0)
            out[syndrome].append(sum(1 << i for i in at))
    return out


def syndrome(word: Column, coded: int) -> Column:
    """The syndrome of a part's coded bits: position i counts as the number i + 1."""
    checks = []
    for j in range(coded.bit_length()):
        mask = sum(1 << i for i in range(coded) if (i + 1) >> j & 1)
        checks.append((F.bit_count(word.bitwiseAND(F.lit(mask).cast("bigint"))) % 2) * F.lit(1 << j))
    return reduce(lambda x, y: x + y, checks).cast("int")


def links(fps: DataFrame, fp: str = "simhash") -> DataFrame:
    """(lo, hi): the pairs of different fingerprints in fps with THRESHOLD differing bits or fewer."""
    one = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    # The few rows become many, so they are dealt out anew; by fp itself, this would fold into the distinct, whose partitions adaptive execution joins.
    one = one.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    homes, copies = [], []
    for name, shift, bits, coded, may in PARTS:
        word = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        near = lambda reach: F.from_json(F.lit(json.dumps(patterns(bits, coded, reach))), "array<array<bigint>>")  # noqa: B023, E731
        at = one.select("fp", word.alias("word")).select("fp", "word", (syndrome(F.col("word"), coded) + 1).alias("s"))
        home = F.element_at(F.element_at(near(RADIUS), F.col("s")), 1)  # the pattern of fewest bits
        homes.append(at.select(F.lit(name).alias("part"), F.col("word").bitwiseXOR(home).alias("anchor"), F.col("fp").alias("lo")))
        each = at.select("fp", "word", F.explode(F.element_at(near(RADIUS + may), F.col("s"))).alias("p"))
        copies.append(each.select(F.lit(name).alias("part"), F.col("word").bitwiseXOR(F.col("p")).alias("anchor"), F.col("fp").alias("hi")))
    found = []
    for h, c in zip(homes, copies, strict=True):
        close = (F.col("lo") < F.col("hi")) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= THRESHOLD)
        found.append(c.drop("part").join(h.drop("part").hint("shuffle_hash"), "anchor").where(close).select("lo", "hi"))
    return found[0].union(found[1]).distinct()


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(k, text_hash, simhash) of each row, and (simhash, node, root) of each distinct fingerprint.

    A node is struct(the smallest key of the fingerprint is null, that key, the fingerprint), in this order; root is the smallest node reachable. So a
    component has the key of its root, and no join by component, which may hold a third of all rows, is needed to find it.
    """
    rows = fingerprints(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t")
    rows = written(rows.select("k", F.xxhash64(F.coalesce("t", F.lit(""))).alias("text_hash"), "simhash"))
    node = F.struct(F.min("k").isNull().alias("none"), F.min("k").alias("key"), F.col("simhash").alias("fp"))
    nodes = written(rows.groupBy("simhash").agg(node.alias("node")))
    at = lambda end, out: nodes.select(F.col("simhash").alias(end), F.col("node").alias(out))
    edges = links(nodes).join(at("lo", "a"), "lo").join(at("hi", "b"), "hi")
    comp = connected_components(edges.select("a", "b"), "a", "b")
    named = nodes.join(comp.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return rows, named.select("simhash", "node", F.coalesce("component", "node").alias("root"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, simhash, component_id): the smallest key reachable over links, for each row of docs.

    Texts without words, null and empty ones among them, have fingerprint 0 and link like any other. Texts are read whole. Equal fingerprints are one class:
    copies are never paired. Rows that repeat a key are grouped each by its own text. Rows with a null key get a fingerprint and take part, but give no
    component their key: where all keys of one are null, so is component_id. Other columns aren't read. An empty table gives no rows.
    """
    rows, named = _grouped(docs, key, text)
    return rows.join(named.select("simhash", F.col("root.key").alias("component_id")), "simhash").select(F.col("k").alias(key), "simhash", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every whole text."""
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each group of near-duplicates, with the columns of docs whatever their names.

    It is a row of the group's smallest doc_id; where that id repeats in the group, the first by a hash of all columns. A group whose ids are all null keeps its
    first row by that hash. Null and empty texts are near-duplicates of each other and keep one row. Texts are compared whole; an empty table stays empty.
    """
    rows, named = _grouped(docs, "doc_id", "text")
    t, h = F.coalesce("text", F.lit("")), unused("_hash", docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(F.to_json(row))
    # Rows of a group's smallest id are told from others under that id by their text.
    same = rows.join(named, "simhash").where("not root.none and k = root.key").select("k", "text_hash", F.col("root.fp").alias("root")).distinct()
    known = docs.where("doc_id is not null").withColumn(h, F.xxhash64(t))
    # The id alone is the key of the join, so that the aggregation needs no shuffle of its own.
    known = known.join(same, (known.doc_id == same.k) & (known[h].bitwiseXOR(same.text_hash) == 0)).groupBy("doc_id", "root").agg(F.min_by(row, order).alias("row")).select("row.*")
    nameless = fingerprints(docs.where("doc_id is null"), "text", h)
    alone = named.where("root.none").select("simhash", F.col("root.fp").alias("root"))
    nameless = nameless.join(alone, nameless[h] == alone.simhash).groupBy("root").agg(F.min_by(row, order).alias("row")).select("row.*")
    return known.union(nameless)
